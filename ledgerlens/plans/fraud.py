"""Fraud features end to end: everything learned on the training split, applied to every split."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.lexicons import FREE_MAIL
from ledgerlens.operators import columns as C
from ledgerlens.operators import encode as E
from ledgerlens.operators import history as H
from ledgerlens.operators.ordering import only_row


@dataclass
class Schema:
    """Column roles of a transaction table."""

    unique_id: str
    ts: str
    amount: str
    target: str
    card: str
    address: str
    email: str
    product: str
    epoch: str
    other_email: str | None = None
    extra_cards: Sequence[str] = ()
    match_columns: Sequence[str] = ()
    fill_columns: Sequence[str] = ()
    label_columns: Sequence[str] = ()
    flag_rate: float = 0.10
    free_mail: Sequence[str] = field(default_factory=lambda: list(FREE_MAIL))


class FraudFeatures:
    def __init__(self, train: DataFrame, schema: Schema):
        s = self.schema = schema
        checked = [c for c in train.columns if c not in (s.unique_id, s.ts, s.target)]
        row = only_row(train.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in checked]))
        self.flagged = [c for c in checked if (row.value(c) or 0) > s.flag_rate]
        timed = C.calendar_parts(train, s.ts, s.epoch)
        self.card = H.fit_amount_stats(timed, s.card, s.amount, "fe_card1", hour="fe_hour")
        self.extra = {c: H.fit_amount_stats(train, c, s.amount, f"fe_{c}", target=s.target) for c in s.extra_cards}
        uid = self._with_uid(train)
        self.uid = {n: E.fit_target_rate(uid, [f"_{n}"], s.target) for n in ("uid2", "uid3")}
        self.mail = E.fit_target_rate(train, [s.email], s.target, smoothing=50)
        self.other_mail = E.fit_target_rate(train, [s.other_email], s.target, smoothing=50) if s.other_email else None
        self.mail_counts = E.fit_frequency(train, s.email)
        self.deciles = E.fit_quantile_edges(train, s.amount, 10)
        self.products = E.fit_ordinal(train, s.product)
        self.medians = E.fit_medians(train, s.fill_columns) if s.fill_columns else None
        self.codes = {c: E.fit_ordinal(train, c) for c in s.label_columns}

    def _with_uid(self, df: DataFrame) -> DataFrame:
        s = self.schema
        return df.withColumns({"_uid2": E.composite_key([s.card, s.address]), "_uid3": E.composite_key([s.card, s.address, s.email])})

    def apply(self, df: DataFrame) -> DataFrame:
        s = self.schema
        out = C.missing_flags(df, self.flagged)
        out = C.calendar_parts(out, s.ts, s.epoch)
        out = H.velocity(out, s.ts, s.unique_id, s.amount, {"card1": s.card, "addr": s.address, "email": s.email}, s.epoch)
        out = H.apply_amount_stats(out, self.card, s.card, "fe_card1", s.amount)
        out = self._with_uid(out)
        out = E.apply_target_rate(out, self.uid["uid2"], ["_uid2"], "fe_uid2_fraud_rate", "fe_uid2_txn_count")
        out = E.apply_target_rate(out, self.uid["uid3"], ["_uid3"], "fe_uid3_fraud_rate").drop("_uid2", "_uid3")
        for c, stats in self.extra.items():
            out = H.apply_amount_stats(out, stats, c, f"fe_{c}")
        out = E.apply_target_rate(out, self.mail, [s.email], "fe_P_email_fraud_rate")
        out = C.membership_flag(out, s.email, s.free_mail, "fe_P_email_is_free")
        out = E.rare_flag(out, self.mail_counts, s.email, "fe_P_email_is_rare")
        if s.other_email:
            out = E.apply_target_rate(out, self.other_mail, [s.other_email], "fe_R_email_fraud_rate")
            out = C.equality_flag(out, s.email, s.other_email, "fe_email_domain_match")
        out = C.amount_parts(out, s.amount)
        out = E.apply_quantile_bins(out, self.deciles, s.amount, "fe_amount_decile")
        out = E.apply_ordinal(out, self.products, s.product, "_product")
        out = out.withColumn("fe_amount_x_product", F.col("fe_log_amount") * F.greatest(F.col("_product"), F.lit(0))).drop("_product")
        if s.match_columns:
            out = C.match_flags(out, s.match_columns)
        if self.medians is not None:
            out = E.fill_from(out, self.medians, s.fill_columns)
        for c, stats in self.codes.items():
            out = E.apply_ordinal(out, stats, c, f"{c}_code")
        return out
