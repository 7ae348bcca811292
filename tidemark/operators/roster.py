"""Rosters: lists of links that a person has signed. A link names symbols; roots come from the chain of predecessors.

A link of a roster carries what its gates measured, so that a reader can check it without the bars: see LINK. Manual links carry a ratifier and a note
in place of the gates that did not admit them.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import isin_check_ok, issue_serial, issuer_prefix, ratio_band
from ..plans.storage import kept
from .bitemporal import latest_version
from .checks import IntegrityError, assert_empty
from .identity import MAX_GAP_DAYS, flatness

#: A link and the measures of its gates. A roster may leave columns out, which are then null.
LINK = {
    "predecessor": "bigint", "successor": "bigint", "boundary": "date", "reason": "string", "note": "string", "ratified_by": "string", "ratified_at": "date",
    "predecessor_isin": "string", "successor_isin": "string", "last_date": "date", "first_date": "date", "check_digit": "boolean", "issuer": "string",
    "serial": "string", "sessions_between": "int", "unsettled_between": "int", "archive_unsettled": "int", "days_between": "int", "ratio": "double", "band": "string",
}
GATE_FIELDS = ("last_date", "first_date", "check_digit", "issuer", "serial", "sessions_between", "unsettled_between", "archive_unsettled", "days_between", "ratio", "band")


def whole(links: DataFrame) -> DataFrame:
    """The links with all columns of LINK; those that they lack are null."""
    return links.select(*[(F.col(k) if k in links.columns else F.lit(None)).cast(t).alias(k) for k, t in LINK.items()])


def _broken(rules: list[tuple[Column, str]]) -> Column:
    """The names of the rules that do not hold; a rule that is unknown does not hold."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in rules]))


def structural_violations(links: DataFrame) -> DataFrame:
    """(predecessor, successor, rules): links without both symbols, to themselves, of an unknown reason or without a boundary, that share an end with another
    link, or that run in a circle."""
    rows = whole(links)
    rules = [
        (F.col("predecessor").isNotNull() & F.col("successor").isNotNull(), "a symbol is missing"),
        (~F.coalesce(F.col("predecessor") == F.col("successor"), F.lit(False)), "a symbol succeeds itself"),
        (F.col("reason").isin("succession", "manual"), "unknown reason"),
        (F.col("boundary").isNotNull(), "no boundary"),
    ]
    out = rows.select("predecessor", "successor", _broken(rules).alias("rules")).where("size(rules) > 0")
    for side, name in (("predecessor", "G5: one predecessor, two links"), ("successor", "G5: one successor, two links")):
        twice = rows.where(F.col(side).isNotNull()).groupBy(side).count().where("count > 1").select(side)
        out = out.unionByName(rows.join(twice, side, "left_semi").select("predecessor", "successor", F.array(F.lit(name)).alias("rules")))
    return out


def gate_violations(links: DataFrame, max_gap_days: int = MAX_GAP_DAYS) -> DataFrame:
    """(predecessor, successor, rules): links whose stated gates do not hold or do not describe them.

    Of every link: two well-formed ISINs with right check digits (G0), a boundary that is the successor's first bar, and stretches that do not meet (G3). A manual link
    further needs a ratifier, the day of it and a note; a succession needs INE equity (G0), one issuer (G1), a rising serial (G2), no session and no
    unsettled day between (G4, G4a), a gap of 1 to max_gap_days days (G4b), and a ratio inside the band that it states (G6)."""
    rows = whole(links)
    ps, ss = issue_serial("predecessor_isin"), issue_serial("successor_isin")
    said = lambda c, want: F.col(c).eqNullSafe(want)
    every = [
        (isin_check_ok("predecessor_isin") & isin_check_ok("successor_isin"), "G0: an ISIN fails its check digit"),
        (F.col("predecessor_isin") != F.col("successor_isin"), "one ISIN twice"),
        (said("check_digit", F.lit(True)), "G0: the stated check digit is not right"),
        (F.col("boundary") == F.col("first_date"), "the boundary is not the successor's first bar"),
        (F.col("last_date") < F.col("first_date"), "G3: the stretches meet"),
    ]
    by_hand = [
        (F.length("ratified_by") > 0, "a manual link needs a ratifier"),
        (F.col("ratified_at").isNotNull(), "a manual link needs the day it was ratified"),
        (F.length("note") > 0, "a manual link needs a note"),
    ]
    found = [
        (F.col("predecessor_isin").startswith("INE") & F.col("successor_isin").startswith("INE"), "G0: no equity"),
        (issuer_prefix("predecessor_isin") == issuer_prefix("successor_isin"), "G1: two issuers"),
        (said("issuer", issuer_prefix("predecessor_isin")), "G1: the stated issuer is another"),
        (ss > ps, "G2: the serial does not rise"),
        (said("serial", F.concat(F.lpad(ps.cast("string"), 2, "0"), F.lit("->"), F.lpad(ss.cast("string"), 2, "0"))), "G2: the stated serials are others"),
        (F.col("sessions_between") == 0, "G4: sessions between"),
        (F.col("unsettled_between") == 0, "G4a: unsettled days between"),
        (F.coalesce("archive_unsettled", F.lit(0)) == 0, "G4a: the archive has holes"),
        (F.col("days_between") >= 1, "G4b: no day between"),
        (F.datediff("first_date", "last_date") == F.col("days_between"), "G4b: the stated days are others"),
        (F.col("days_between") <= max_gap_days, "G4b: too many days between"),
        (ratio_band("ratio").isNotNull(), "G6: the ratio is in no band"),
        (said("band", ratio_band("ratio")), "G6: the stated band is another"),
    ]
    rules = F.concat(_broken(every), F.when(F.col("reason") == "manual", _broken(by_hand)).otherwise(_broken(found)))
    return rows.select("predecessor", "successor", rules.alias("rules")).where("size(rules) > 0")


def order_violations(links: DataFrame) -> DataFrame:
    """(predecessor, successor, rules): links whose successor's last bar, by the next link of its chain, lies before its first."""
    rows = whole(links)
    later = rows.select(F.col("predecessor").alias("successor"), F.col("last_date").alias("_end"))
    met = rows.join(later, "successor").where("_end < first_date")
    return met.select("predecessor", "successor", F.array(F.lit("G5: a member ends before it begins")).alias("rules"))


def circles(links: DataFrame) -> DataFrame:
    """(symbol_id): the successors that run in a circle."""
    return roots(links).where("root is null").select("symbol_id")


def validate_roster(links: DataFrame, gates: bool = False) -> None:
    """Raises on structural violations and circles and, with gates, on links whose gates do not hold and on chains out of order."""
    assert_empty(structural_violations(links), "roster link")
    if gates:
        assert_empty(gate_violations(links).unionByName(order_violations(links)), "roster link")
    assert_empty(circles(links), "roster: links run in a circle")


def roots(links: DataFrame) -> DataFrame:
    """(symbol_id, root) of every successor: the first symbol of its chain, by doubling the known stretch; null in a circle.

    A chain has at most as many steps as there are links, so what still moves after that stretch is covered runs in a circle. Each step is stored in the shared
    folder, as the next one joins it with itself.
    """
    step = links.select(F.col("successor").alias("symbol_id"), F.col("predecessor").alias("root"))
    for _ in range(links.count().bit_length() + 1):
        up = step.select(F.col("symbol_id").alias("root"), F.col("root").alias("_up"))
        step = step.select("symbol_id", "root").join(up, "root", "left")
        step = kept(step.select("symbol_id", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("_moved")), "roots")
        if step.where("_moved").isEmpty():
            break
    return step.select("symbol_id", F.when(~F.col("_moved"), F.col("root")).alias("root"))


def merged(generated: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A regenerated roster with the manual links of the one before: (links, adopted).

    adopted: each manual link with superseded_generated, whether the generator found the pair too; it then agrees on the boundary and on both ends' bars, and its own line
    goes, as only the manual one names who decided. Where the two disagree, or a manual link shares one end with another generated link, nothing is chosen:
    that is an error which names both. Manual links meet generated ones by pair, predecessor and successor in one aggregation.
    """
    by_hand, found = whole(existing).where("reason = 'manual'"), whole(generated)
    line = F.struct("predecessor", "successor", "boundary", "first_date", "last_date")
    ends = F.explode(F.array(F.struct(F.lit("p").alias("side"), F.col("predecessor").alias("id")), F.struct(F.lit("s").alias("side"), F.col("successor").alias("id")))).alias("_e")
    sides = lambda df, name: df.select(ends, line.alias(name))
    met = sides(by_hand, "_m").unionByName(sides(found, "_g"), allowMissingColumns=True).groupBy("_e")
    met = met.agg(F.collect_list("_m").alias("_ms"), F.collect_list("_g").alias("_gs")).where("size(_ms) > 0 and size(_gs) > 0")  # a few links an end
    met = met.select("_e.side", F.explode("_ms").alias("_m"), "_gs").select("side", "_m", F.explode("_gs").alias("_g"))
    twin = reduce(lambda a, b: a & b, [F.col(f"_m.{c}").eqNullSafe(F.col(f"_g.{c}")) for c in ("predecessor", "successor")])
    same = reduce(lambda a, b: a & b, [F.col(f"_m.{c}").eqNullSafe(F.col(f"_g.{c}")) for c in ("boundary", "first_date", "last_date")])
    rule = F.when(twin & ~same, "a manual and a generated link disagree about the boundary").when(~twin, "a manual and a generated link claim one symbol")
    assert_empty(met.select(rule.alias("rule"), F.col("_m").alias("manual"), F.col("_g").alias("generated")).where("rule is not null"), "roster: it is not for a machine to choose")
    pair = ["predecessor", "successor"]
    pairs = found.select(*pair).distinct().withColumn("superseded_generated", F.lit(True))
    adopted = by_hand.join(pairs, pair, "left").withColumn("superseded_generated", F.coalesce("superseded_generated", F.lit(False)))
    links = found.join(by_hand.select(*pair), pair, "left_anti").unionByName(by_hand)
    validate_roster(links)
    return links, adopted


def append_manual(links: DataFrame, line: DataFrame) -> DataFrame:
    """The roster with one more manual link. A pair that it has already, and a link that breaks the rules of the whole, are errors."""
    pair = ["predecessor", "successor"]
    assert_empty(whole(line).where("reason <> 'manual' or reason is null").select(*pair), "only manual links are appended")
    assert_empty(whole(links).join(whole(line).select(*pair), pair, "left_semi").select(*pair), "the roster has this pair")
    out = whole(links).unionByName(whole(line))
    validate_roster(out)
    return out


def plan_links(roster: DataFrame, links: DataFrame, at: str, seeded_by: str, digest: str = "", symbols: DataFrame | None = None) -> DataFrame:
    """The link rows a roster adds: those of symbols that no link joins yet, or only a retraction. A chain whose root is a member of an entity
    already goes to that entity. Errors: a symbol that the store does not know, and a link that stands with another entity, boundary or
    predecessor; such a link must be retracted first. The evidence holds the gates and who ratified the link."""
    roster = whole(roster)
    if symbols is not None:
        ends = roster.select(F.explode(F.array("predecessor", "successor")).alias("symbol_id")).distinct()
        assert_empty(ends.join(symbols.select("symbol_id").distinct(), "symbol_id", "left_anti"), "symbols that the store does not know")
    now = latest_version(links, ["symbol_id"], None).where("reason <> 'retraction'").select("symbol_id", *[F.col(c).alias(f"_{c}") for c in ("entity_id", "boundary", "predecessor")])
    adopted = now.select(F.col("symbol_id").alias("root"), F.col("_entity_id").alias("_adopted"))
    want = roster.join(roots(roster), roster["successor"] == F.col("symbol_id")).join(adopted, "root", "left")
    want = want.select("symbol_id", F.coalesce("_adopted", "root").alias("entity_id"), "reason", "boundary", "predecessor", "note", "ratified_by", "ratified_at", *GATE_FIELDS)
    rows = want.join(now, "symbol_id", "left")
    same = F.lit(True)
    for c in ("entity_id", "boundary", "predecessor"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    assert_empty(rows.where(F.col("_entity_id").isNotNull() & ~same).select("symbol_id", "entity_id", F.col("_entity_id").alias("stored_entity"), "boundary", F.col("_boundary").alias("stored_boundary")), "a link stands otherwise; retract it first")
    rows = rows.where("_entity_id is null")
    evidence = F.to_json(F.struct("predecessor", F.col("symbol_id").alias("successor"), "boundary", "reason", F.struct(*GATE_FIELDS).alias("gates"), "ratified_by", "ratified_at"))
    return rows.select("symbol_id", "entity_id", "reason", "boundary", "predecessor", evidence.alias("evidence"), F.lit(digest).alias("roster_sha"), F.lit(seeded_by).alias("seeded_by"), "note", F.lit(at).cast("timestamp").alias("ingested_at"))


def plan_retraction(links: DataFrame, at: str, note: str, seeded_by: str, entity_id: int | None = None, symbol_id: int | None = None) -> DataFrame:
    """Rows that take back the links of one entity's members, or of one symbol that is its entity's only linked member: each then stands for
    itself again. Nothing to take back, a root, and one member of several are errors, as they would leave an entity split in silence."""
    if (entity_id is None) == (symbol_id is None):
        raise ValueError("name an entity or a symbol")
    if not note:
        raise ValueError("a retraction needs a note")
    now = latest_version(links, ["symbol_id"], None).where("reason <> 'retraction' and symbol_id <> entity_id")
    if symbol_id is not None:
        own = now.where(F.col("symbol_id") == symbol_id).select("entity_id").first()
        if own is None:
            members = now.where(F.col("entity_id") == symbol_id).count()
            raise IntegrityError(f"symbol {symbol_id} is the root of an entity with {members} members; retract the entity" if members else f"symbol {symbol_id} is not linked")
        entity_id = own["entity_id"]
    now = now.where(F.col("entity_id") == entity_id)
    members = now.count()
    if not members:
        raise IntegrityError(f"entity {entity_id} has no linked members")
    if symbol_id is not None and members > 1:
        raise IntegrityError(f"symbol {symbol_id} is one of {members} members of entity {entity_id}; retract the entity")
    evidence = F.to_json(F.struct(F.col("entity_id").alias("retracted_from"), F.lit("symbol" if symbol_id is not None else "entity").alias("scope")))
    return now.select("symbol_id", F.col("symbol_id").alias("entity_id"), F.lit("retraction").alias("reason"), F.lit(None).cast("date").alias("boundary"), F.lit(None).cast("bigint").alias("predecessor"), evidence.alias("evidence"), F.lit(None).cast("string").alias("roster_sha"), F.lit(seeded_by).alias("seeded_by"), F.lit(note).alias("note"), F.lit(at).cast("timestamp").alias("ingested_at"))


def assert_flat(links: DataFrame, added: DataFrame) -> None:
    """Raises if the links with the added rows would need more than one hop."""
    names = ["symbol_id", "entity_id", "ingested_at"]
    assert_empty(flatness(links.select(names).unionByName(added.select(names)), None), "a link leads to a symbol that is linked on")


def review_lines(cands: DataFrame, at: str) -> DataFrame:
    """Candidates for a person to review, as JSON lines: first a header that says what the lines hold and what they do not, then the lines in order."""
    head = cands.agg(F.count(F.lit(1)).alias("_n")).select(F.to_json(F.struct(F.lit(1).alias("review_version"), F.lit(at).alias("as_of"), F.col("_n").alias("candidates"), F.lit(",".join(cands.columns)).alias("fields"), F.lit("delivery is in neither source at a boundary").alias("not_measured"))).alias("value"), F.lit(0).alias("_o"), F.lit(0).cast("bigint").alias("_p"), F.lit(0).cast("bigint").alias("_s"))
    lines = cands.select(F.to_json(F.struct(*cands.columns)).alias("value"), F.lit(1).alias("_o"), F.col("predecessor").alias("_p"), F.col("successor").alias("_s"))
    return head.unionByName(lines).orderBy("_o", "_p", "_s").select("value")


def roster_document(links: list[dict], version: int = 1) -> str:
    """The roster file: links in order, with the digest of its canonical JSON."""
    from .provenance import digest_of

    body = {"version": version, "links": sorted(links, key=lambda x: (x["predecessor"], x["successor"]))}
    return json.dumps(body | {"digest": digest_of(body)}, indent=2, sort_keys=True)


def load_roster(text: str) -> list[dict]:
    """The links of a roster file. Unknown fields and a stated digest that is not that of the content are errors."""
    from .provenance import digest_of

    doc = json.loads(text)
    if extra := set(doc) - {"version", "links", "digest"}:
        raise ValueError(f"unknown fields {sorted(extra)}")
    if doc.get("version") != 1:
        raise ValueError("unknown roster version")
    known = set(LINK)
    if extra := {k for x in doc["links"] for k in x} - known:
        raise ValueError(f"unknown link fields {sorted(extra)}")
    if doc.get("digest") != digest_of({k: v for k, v in doc.items() if k != "digest"}):
        raise ValueError("the stated digest is not that of the content")
    return doc["links"]
