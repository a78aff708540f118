"""Card profiles kept up to date from changes of cards and customers: a stateful join by the customer.

A card's change goes to its customer, and a customer's change to its cards; what comes out are the profiles that changed, or
ended, and nothing else. Neither table is read again. A first stateful step keeps each card's customer, so that a card
that moves leaves its old customer; the second keeps a customer with its cards in a map, from which it makes profiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

_CARD = ("status", "daily_limit_minor", "currency")
_CUSTOMER = ("risk_tier", "home_country", "home_lat", "home_lon")
#: Between the steps, whole numbers that may be missing are texts: pandas would make them doubles, which state variables of
#: type long take for null.
_SENT = "status string, daily_limit_minor string, currency string, risk_tier string, home_country string, home_lat double, home_lon double"
_FIELDS = "status string, daily_limit_minor long, currency string, risk_tier string, home_country string, home_lat double, home_lon double"


def _rows(frames: Iterator[pd.DataFrame]) -> list[dict]:
    """Records in order of seq, None for what is missing."""
    feed = pd.concat(list(frames), ignore_index=True)
    return sorted(feed.astype(object).where(feed.notna(), None).to_dict("records"), key=lambda r: r["seq"])


class Router(StatefulProcessor):
    """Keyed by card: sends each new version to the card's customer, and word to the customer that it leaves."""

    names = ("customer_id", "card_id", "seq", "act", "moved", *_CARD, *_CUSTOMER)

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "seq long, customer_id string, live boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq, customer, live = self.last.get() if self.last.exists() else (None, None, False)
        out = []
        for r in _rows(rows):
            if seq is not None and r["seq"] <= seq:
                continue  # an older version, or one that was read again
            own = dict.fromkeys(_CUSTOMER)
            if live and (not r["live"] or r["customer_id"] != customer):
                out.append({"customer_id": customer, "card_id": key[0], "seq": r["seq"], "act": "leave" if r["live"] else "gone", "moved": False, **dict.fromkeys(_CARD), **own})
            if r["live"]:
                out.append({"customer_id": r["customer_id"], "card_id": key[0], "seq": r["seq"], "act": "join", "moved": live and r["customer_id"] != customer, **{c: r[c] for c in _CARD}, **own})
            seq, customer, live = r["seq"], r["customer_id"], bool(r["live"])
        self.last.update((seq, customer, live))
        if out:
            yield pd.DataFrame(out, columns=list(self.names))

    def close(self) -> None:
        pass


class Profiles(StatefulProcessor):
    """Keyed by customer: the customer's last version, and its cards in a map. A card's profile is returned when it
    differs from before, a deletion when it had one."""

    names = ("card_id", "card_seq", "customer_seq", "live", "customer_id", *_CARD, *_CUSTOMER)

    def init(self, handle) -> None:
        self.customer = handle.getValueState("customer", "seq long, live boolean, risk_tier string, home_country string, home_lat double, home_lon double")
        self.cards = handle.getMapState("cards", "card_id string", "seq long, status string, daily_limit_minor long, currency string, shown boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.customer.get() if self.customer.exists() else None
        now, touched, ended = before, {}, {}
        for r in _rows(rows):
            card = r["card_id"]
            if r["act"] == "customer":
                if now is None or r["seq"] > now[0]:
                    now = (r["seq"], bool(r["moved"]), *(r[c] for c in _CUSTOMER))
            elif r["act"] == "join":
                had = touched.get(card) or (self.cards.getValue((card,)) if self.cards.containsKey((card,)) else None)
                # a card that comes from another customer may have a profile from there
                limit = r["daily_limit_minor"]
                touched[card] = (r["seq"], r["status"], None if limit is None else int(limit), r["currency"], bool(r["moved"]) or bool(had and had[4]))
                ended.pop(card, None)
            else:
                had = touched.pop(card, None) or (self.cards.getValue((card,)) if self.cards.containsKey((card,)) else None)
                if r["act"] == "gone" and had is not None and had[4]:
                    ended[card] = r["seq"]
                else:
                    ended.setdefault(card, None)
        if now is not None and now != before:
            self.customer.update(now)
            for (card,), value in list(self.cards.iterator()):
                if card not in ended:
                    touched.setdefault(card, tuple(value))
        live, out = now is not None and now[1], []
        customer_seq = -1 if now is None else now[0]
        for card, (seq, *fields, shown) in touched.items():
            if live:
                out.append((card, seq, customer_seq, True, key[0], *fields, *now[2:]))
            elif shown:
                out.append((card, seq, customer_seq, False, key[0], *[None] * 7))
            self.cards.updateValue((card,), (seq, *fields, live))
        for card, seq in ended.items():
            if seq is not None:
                out.append((card, seq, customer_seq, False, key[0], *[None] * 7))
            if self.cards.containsKey((card,)):
                self.cards.removeKey((card,))
        if out:
            yield pd.DataFrame(out, columns=list(self.names), dtype=object)

    def close(self) -> None:
        pass


def profile_changes(cards: DataFrame, customers: DataFrame) -> DataFrame:
    """A stream of changed profiles from streams of changes: cards (card_id, seq, live, customer_id, status,
    daily_limit_minor, currency) and customers (customer_id, seq, live, risk_tier, home_country, home_lat, home_lon), where
    ``live`` false deletes. Each has its own rising ``seq``; what repeats, or is older than what is known, is ignored.

    Rows are (card_id, card_seq, customer_seq, live, ...): the pair of numbers rises with every change of a card's profile,
    so ``current`` finds the profiles in force however the changes are stored.
    """
    text = lambda c: F.col(c).cast("string").alias(c)
    cards = cards.select(text("card_id"), F.col("seq").cast("long").alias("seq"), "live", text("customer_id"), "status", text("daily_limit_minor"), "currency")
    routed = cards.groupBy("card_id").transformWithStateInPandas(Router(), f"customer_id string, card_id string, seq long, act string, moved boolean, {_SENT}", "append", "none")
    none = [F.lit(None).cast(kind).alias(c) for c, kind in zip(_CARD, ("string", "string", "string"), strict=True)]
    sent = customers.select(text("customer_id"), F.lit(None).cast("string").alias("card_id"), F.col("seq").cast("long").alias("seq"), F.lit("customer").alias("act"), F.col("live").alias("moved"), *none, *_CUSTOMER)
    return routed.unionByName(sent).groupBy("customer_id").transformWithStateInPandas(Profiles(), f"card_id string, card_seq long, customer_seq long, live boolean, customer_id string, {_FIELDS}", "append", "none")


def current(changes: DataFrame) -> DataFrame:
    """The profiles in force: each card's last change, unless that ended it."""
    rest = [c for c in changes.columns if c not in ("card_id", "card_seq", "customer_seq")]
    last = changes.groupBy("card_id").agg(F.max_by(F.struct(*rest), F.struct("card_seq", "customer_seq", "live")).alias("v"))
    return last.select("card_id", "v.*").where("live").drop("live")
