"""Word lists that the text features look up.

Fixed values: the lists must hold exactly these words for the features to
agree with published results. Every function that uses one also takes its own
list as an argument.
"""

# Finance sentiment seed words (after Loughran and McDonald, 2011).
POSITIVE = """
able abundance abundant acclaimed accomplish accomplished achievement acumen adaptable adequate advance
advanced advantage advantaged advantageous affirm affordable agile agree ahead ample appreciation appreciate
appreciated approval approved apt arise assure attain attained attractive award awarded balance beneficial
benefit best better bold boom boost breakthrough brilliant capable certain certainty clear climb comfort
commend competitive confidence confident consistent convenient creative dedicated deliver delivered demand
dependable desirable developed dividend dominant double drive driven durable dynamic earn earned earnings
effective efficient efficiency elevated enhance enhanced enjoy enormous exceed exceeded exceeds excellent
exceptional exciting expand expanded expansion expedient experienced expert extraordinary favorable
flexibility flexible flourish gain gains good great grow growing growth healthy higher highest honored ideal
improved improvement improving impressive increase increased increasing industry-leading innovative integrity
invest investment leading leverage loyal lucrative maintain manageable maximize merit momentum notable obtain
opportunity optimism optimistic outperform outstanding overcome perform performance positive potential power
premier premium productive profit profitable profitability progress promising prosper prosperity proven
quality reach recover recovery reliable remarkable resilient revenue reward rise robust satisfactory
significant solid sound stable strength strong succeed success successful superior surge sustainability
sustainable trusted upward value versatile viable yield
""".split()

NEGATIVE = """
abandon abandonment abrupt absence abuse accident adverse adversely adversity against allegation allege
anomaly anti anxiety arbitrary assault assertion bankrupt bankruptcy barrier below breach broke burden cancel
cancellation casualty cease challenged challenging charge claim collapse complaint complexity compel concern
concerns conflict constrain constraint controversy costly crisis critical cut cuts damage damaged decline
declined declining decrease decreased default defect deficit delay delinquent departure depressed deteriorate
deterioration difficult difficulties difficulty diminish disappoint disappointing disappointment disaster
disclose discontinue disputed disrupt disruption distress downturn drop eliminated enforcement error excessive
expensive exposure fail failure falling fault fine force foreclose fraud harm hazard hurt impair impairment
inability inadequate incident incur inferior insolvent insufficient invalid investigation issue layoff layoffs
liabilities liability limitation liquidation litigation loss losses lost lower miss missed misstatement
negative noncompliance nonperformance objection obstacle offset omit overdue penalty poor problems recession
reduced reduction reject resigned restructure restructuring risk risks severe shortage slowdown suspect
terminate termination uncertainty underperform unfavorable unprofitable violation volatile volatility
vulnerable weak weakness withdraw worst write-down write-off writedown writeoff
""".split() + ["revenue loss"]

UNCERTAINTY = """
alleged almost ambiguity ambiguous anticipate anticipated appear appears approximate approximately arbitrage
assume assumption await believe believes cautious conditional contingent could depend depending doubtful
essentially estimate estimated estimates estimating evaluation evolve evolving expect expected expectation
feasibility fluctuate forecast generally historically hope if impending indefinite indeterminate indication
indicative intend intention likely may might nominal ongoing ordinarily outlook partial pending perceive
perhaps plan planned planning possible possibly potential predominantly preliminary presumed probable probably
projected projection propose proposed prospect roughly seek should somewhat speculate subjective suggest
typically uncertain uncertainty unclear unresolved variable whether would
""".split()

MODAL_STRONG = """
absolve binding certain certainly certainty commit commitment committed compel compelled compulsory conclude
conclusive conclusively confirm confirmed contractual decided decisive definite definitely enforce established
final finally firmly guarantee guaranteed imperative mandate mandatory must necessarily necessary obligate
obligation obligatory require required requirement resolve resolved shall unconditional undeniable undoubtedly
unequivocal unquestionably will
""".split()

# Words left out of n-gram counts.
STOPWORDS = """
the a an and or but in on at to for of with by from is are was were be been has have had will would could
should may might its it this that these those as than also more not no s which while about after over up
during into through between each both
""".split()

# Report words left out of term weights on top of the general list.
REPORT_STOPWORDS = """
company companies corp inc ltd plc group said year quarter annual fiscal report reported says million billion
per cent percent
""".split()

# Parts of text that mark a negation.
NEGATIONS = ["not ", " no ", "never", "n't", "cannot", "neither", "nor"]

# Patterns of climate disclosure words; "." stands for any character.
CLIMATE = """
emission carbon climate renewable sustainable green net.zero scope esg environmental biodiversity recycl
circulat clean.energy decarboni offset ghg footprint
""".split()

# Free mail providers.
FREE_MAIL = """
gmail.com yahoo.com hotmail.com outlook.com live.com aol.com icloud.com mail.com protonmail.com yandex.com
qq.com 163.com
""".split()
