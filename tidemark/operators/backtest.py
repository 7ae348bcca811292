"""Backtests: everything that does not depend on cash is a table; only the book itself is walked session by session.

Ranks, stances, opens, closes and share ratios of all sessions are joined first. Then each run, that is a strategy with its offset
and costs, is one group: a fold over its sessions that keeps cash, positions and pending orders. A group holds
the bars of entities that the run ever ranks among its picks, so its size is sessions times picks, not the market's.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .costs import COMPONENTS, NOTE, RATES

EVENTS = "run string, date date, seq int, kind string, entity_id bigint, side string, qty bigint, price double, charges double, amount double, cash double, held int, detail string"
DROP = -0.33


@dataclass(frozen=True)
class Setup:
    """What one run trades with. floor: the smallest order worth placing; None: what the broker's charges make it, see smallest_order."""

    capital: float = 500_000.0
    top: int = 12
    cash_buffer: float = 0.01
    broker: str = "zerodha"
    slippage_bps: float = 0.0
    floor: float | None = None
    max_positions: int = 20
    max_stock: float = 0.25
    max_book: float = 0.0
    min_trade: float = 0.0
    kill: str = ""
    daily_loss_cap: float = 0.0


def rate_at(component: str, product: str, side: str, broker: str, day: str) -> tuple:
    """The rate in force: most specific first, then latest."""
    fits = [r for r in RATES if r[0] == component and r[1] in (None, product) and r[2] in (None, side) and r[3] in (None, broker) and r[4] <= day]
    if not fits:
        raise ValueError(f"no rate for {component}, {product}, {side}, {broker} on {day}")
    return max(fits, key=lambda r: (sum(x is not None for x in r[1:4]), r[4]))


def paisa(x: float) -> float:
    return math.copysign(math.floor(abs(x) * 100 + 0.5), x) / 100


def charge(qty: int, price: float, side: str, broker: str, day: str, product: str = "equity") -> float:
    """All charges of one trade but the depository's, as trade_charges() has them."""
    turnover = paisa(qty * price)
    lines = {}
    for c in COMPONENTS:
        _, _, _, _, _, basis, value, cap, floor, _ = rate_at(c, product, side, broker, day)
        lines[c] = value if c == "gst" else paisa({"zero": 0.0, "flat": value, "percent": value * turnover, "capped": max(min(value * turnover, cap or 0.0), floor or 0.0)}[basis])
    taxable = paisa(lines["brokerage"] + lines["exchange"] + lines["sebi"] + lines["ipf"])
    return paisa(taxable + paisa(lines["gst"] * taxable) + lines["stt"] + lines["stamp"])


@lru_cache(maxsize=64)
def smallest_order(broker: str, day: str = NOTE, slippage_bps: float = 0.0, cap: float = 0.005, step: int = 100, highest: int = 2_000_000) -> float:
    """The least whole multiple of `step` whose round trip costs at most a share of it, as costs.min_notional() finds it. No such order is an error."""
    dp = rate_at("dp", "equity", "sell", broker, day)[6]
    for n in range(step, highest + 1, step):
        cost = charge(1, float(n), "buy", broker, day) + charge(1, float(n), "sell", broker, day)
        if paisa(cost + dp + 2 * n * slippage_bps / 10000) / n <= cap:
            return float(n)
    raise ValueError(f"no order is worth placing with {broker}")


@dataclass
class Book:
    cash: float
    qty: dict[int, int] = field(default_factory=dict)
    basis: dict[int, float] = field(default_factory=dict)
    mark: dict[int, float] = field(default_factory=dict)

    def equity(self, closes: dict[int, float]) -> float:
        return self.cash + sum(q * m if (m := closes.get(e, self.mark[e])) > 0 else self.basis[e] for e, q in self.qty.items())

    def rescale(self, e: int, ratio: float) -> float:
        """A share action: whole shares stay, the fraction is paid at the mark after it. Returns what was paid."""
        exact = self.qty[e] * ratio
        self.qty[e] = math.floor(exact)
        self.mark[e] /= ratio
        paid = (exact - self.qty[e]) * self.mark[e]
        self.cash += paid
        if not self.qty[e]:
            self.forget(e)
        return paid

    def forget(self, e: int) -> None:
        for d in (self.qty, self.basis, self.mark):
            del d[e]

    def fill(self, e: int, side: str, qty: int, price: float, costs: float) -> bool:
        """Buys need cash for price and costs; False if there is too little. Sales take the basis out in proportion."""
        if side == "buy":
            if qty * price + costs > self.cash + 1e-9:
                return False
            self.cash -= qty * price + costs
            self.qty[e] = self.qty.get(e, 0) + qty
            self.basis[e] = self.basis.get(e, 0.0) + qty * price + costs
            self.mark[e] = price
            return True
        self.cash += qty * price - costs
        self.basis[e] *= 1 - qty / self.qty[e]
        self.qty[e] -= qty
        self.mark[e] = price
        if not self.qty[e]:
            self.forget(e)
        return True


def gate(intents: list[tuple[int, str, int, float]], values: dict[int, float], equity: float, s: Setup, day_pnl: float = 0.0) -> list[tuple[tuple, str]]:
    """Each intent (entity, side, qty, price) with the rule that rejects it, or an empty string. Accepted ones change the working book."""
    pos, out = dict(values), []
    book = sum(v for v in pos.values() if v > 0)
    floor = smallest_order(s.broker) if s.floor is None else s.floor
    for x in intents:
        e, side, qty, price = x
        n = qty * price
        rule = ""
        if e is None or e <= 0 or qty <= 0 or price <= 0 or side not in ("buy", "sell"):
            rule = "malformed"
        elif s.kill:
            rule = "kill switch"
        elif side == "sell":
            book -= n
            pos[e] = pos.get(e, 0.0) - n
            if pos[e] <= 0:
                del pos[e]
        elif s.daily_loss_cap > 0 and day_pnl <= -s.daily_loss_cap:
            rule = "daily loss"
        elif n < floor:
            rule = "below the floor"
        elif e not in pos and len(pos) >= s.max_positions:
            rule = "too many positions"
        elif equity > 0 and (pos.get(e, 0.0) + n) / equity > s.max_stock:
            rule = "too much of one name"
        elif s.max_book > 0 and book + n > s.max_book:
            rule = "book too large"
        else:
            pos[e] = pos.get(e, 0.0) + n
            book += n
        out.append((x, rule))
    return out


def targets(book: Book, ranked: list[int], closes: dict[int, float], equity: float, s: Setup) -> list[tuple[int, str, int, float]]:
    """Orders that bring the book to equal parts of the picks: sales first, small changes of held names left alone."""
    part = equity * (1 - s.cash_buffer) / s.top
    want = {e: int(part / closes[e]) for e in ranked[: s.top] if closes.get(e, 0.0) > 0}
    want = {e: q for e, q in want.items() if q > 0}
    out = []
    for e in sorted(book.qty):
        less, price = book.qty[e] - want.get(e, 0), closes.get(e, 0.0) or book.mark[e]
        if less > 0 and not (want.get(e) and less * price < s.min_trade):
            out.append((e, "sell", less, price))
    for e, q in want.items():
        more = q - book.qty.get(e, 0)
        if more > 0 and not (e in book.qty and more * closes[e] < s.min_trade):
            out.append((e, "buy", more, closes[e]))
    return out


def walk(run: str, days: pd.DataFrame, s: Setup) -> pd.DataFrame:
    """The fold of one run over rows (date, entity_id, open, close, ratio, rank, stance, rebalance) in order of date.

    A session: share actions on held and pending quantities, pending orders at the open with sales first, a look for unexplained falls, marks,
    then the decision, whose accepted orders wait for the next open.
    """
    book, pending, out = Book(s.capital), [], []

    def tell(day, kind, e=None, side=None, qty=None, price=None, costs=None, amount=None, detail=None):
        out.append((run, day, len(out), kind, e, side, qty, price, costs, amount, book.cash, len(book.qty), detail))

    for day, rows in days.groupby("date", sort=True):
        text = str(day)[:10]
        have = rows[rows["close"].notna()]
        closes = dict(zip(have["entity_id"].astype(int), have["close"].astype(float), strict=True))
        opens = dict(zip(have["entity_id"].astype(int), have["open"].astype(float), strict=True))
        acts = rows[rows["ratio"].notna()]
        ratios = dict(zip(acts["entity_id"].astype(int), acts["ratio"].astype(float), strict=True))
        for e in sorted(ratios.keys() & book.qty.keys()):
            tell(day, "action", e, qty=book.qty[e], amount=book.rescale(e, ratios[e]), detail=f"{ratios[e]:g}")
        pending = [(e, side, max(1, int(q * ratios[e])) if e in ratios else q) for e, side, q in pending]
        charged: set[int] = set()
        for e, side, q in sorted(pending, key=lambda x: (x[1] != "sell", x[0])):
            if opens.get(e, 0.0) <= 0:
                tell(day, "unfilled", e, side, q, detail="the name did not trade")
                continue
            price = opens[e] * (1 + (1 if side == "buy" else -1) * s.slippage_bps / 10000)
            costs = charge(q, price, side, s.broker, text)
            if side == "sell" and e not in charged:
                charged.add(e)
                costs += rate_at("dp", "equity", "sell", s.broker, text)[6]
            if book.fill(e, side, q, price, costs):
                tell(day, "fill", e, side, q, price, costs, q * price)
            else:
                tell(day, "unfilled", e, side, q, price, detail="insufficient cash")
        pending = []
        for e in sorted(book.qty.keys() & closes.keys()):
            if e not in ratios and closes[e] > 0 and book.mark[e] > 0 and closes[e] / book.mark[e] - 1 <= DROP:
                tell(day, "drop", e, qty=book.qty[e], price=closes[e], amount=closes[e] / book.mark[e] - 1)
            book.mark[e] = closes[e] if closes[e] > 0 else book.mark[e]
        equity = book.equity(closes)
        tell(day, "equity", amount=equity)
        stance = rows["stance"].iloc[0]
        if stance == "risk off":
            intents = [(e, "sell", q, closes.get(e, 0.0) or book.mark[e]) for e, q in sorted(book.qty.items())]
        elif stance == "risk on" and bool(rows["rebalance"].iloc[0]):
            picks = rows[rows["rank"].notna()].sort_values("rank")["entity_id"].astype(int).tolist()
            intents = targets(book, picks, closes, equity, s) if picks else []
        else:
            intents = []
        values = {e: q * closes.get(e, book.mark[e]) for e, q in book.qty.items()}
        for (e, side, q, price), rule in gate(intents, values, equity, s):
            if rule:
                tell(day, "rejected", e, side, q, price, detail=rule)
            else:
                pending.append((e, side, q))
    return pd.DataFrame(out, columns=[x.split()[0] for x in EVENTS.split(", ")])


def backtests(prices: DataFrame, actions: DataFrame, ranks: DataFrame, stances: DataFrame, setups: dict[str, Setup]) -> DataFrame:
    """The events of all runs. prices (date, entity_id, open, close), actions (entity_id, ex_date, ratio), ranks (run, date,
    entity_id, rank) on decision days, stances (date, stance).

    Each run reads only the entities that it ranks within its top; runs are spread over the cluster.
    """
    top = max(s.top for s in setups.values())
    picked = ranks.where(F.col("rank") <= top)
    sessions = stances.select("date", "stance").distinct()
    decisions = ranks.select("run", "date").distinct().withColumn("rebalance", F.lit(True))
    runs = prices.sparkSession.createDataFrame([(r,) for r in setups], "run string")  # the caller's list
    days = runs.crossJoin(sessions).join(decisions, ["run", "date"], "left")
    names = picked.select("run", "entity_id").distinct()
    quotes = prices.join(names, "entity_id").select("run", "date", "entity_id", F.col("open").cast("double").alias("open"), F.col("close").cast("double").alias("close"))
    acts = actions.join(names, "entity_id").select("run", F.col("ex_date").alias("date"), "entity_id", "ratio")
    cells = quotes.join(acts, ["run", "date", "entity_id"], "full").join(picked, ["run", "date", "entity_id"], "full")
    rows = days.join(cells, ["run", "date"], "left").select("run", "date", "entity_id", "open", "close", "ratio", "rank", "stance", F.coalesce("rebalance", F.lit(False)).alias("rebalance"))
    return rows.groupBy("run").applyInPandas(lambda key, pdf: walk(key[0], pdf, setups[key[0]]), EVENTS)
