"""Secret scans over an incremental blob ledger. Columns only; no Python runs on the executors.

Every version of every path is content-addressed by the SHA-256 of its text. A ledger holds what has been scanned: one row
for each blob, rule and rule version, with the spans found (none is also a finding). A scan takes the pairs that the ledger
lacks, once for each blob however many paths hold it, and the findings are joined back to all paths.

A history may come in increments: each is scanned against the ledger of those before it, which is written between them. Texts
move once, to meet their copies; the findings are joined to rows without texts, and those of a blob that very many paths hold
are looked up by a bounded broadcast.

Defined results: a null text is the empty blob; repeated rows give repeated results; rows without an id are scanned like all
others; other columns pass through whatever their names; an empty history gives an empty result; an empty or missing ledger means
that nothing has been scanned; a ledger may hold other rules, other versions and blobs that no path holds any more.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .graph import lookup

#: Matches whose places are summed up in one go; more are taken in chunks, so the work isn't quadratic in the matches of a text.
CHUNK = 256


@dataclass(frozen=True)
class Rule:
    """pattern: matched leftmost and without overlap. value: the group whose length counts. hint: a cheap test that every match passes."""

    kind: str
    version: int
    pattern: str
    value: int
    min_chars: int
    hint: str


#: Fixed patterns of the base kinds.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"(?i)(?:passw|secret|token|api)[a-z_]*[\"']?\x20*[:=]"),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24, r"[0-9a-f]{24}"),
)
_SPANS = "array<struct<start:int,end:int>>"


def spans(text: Column, rule: Rule) -> Column:
    """Spans of the rule's matches in code points, end exclusive: lengths of the matches and of what lies between are summed up."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = found if rule.value == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.value))
    steps = F.zip_with(F.slice(F.split(text, rule.pattern, -1), 1, F.size(found)), F.arrays_zip(found.alias("m"), value.alias("v")), lambda gap, mv: F.struct(F.char_length(gap).alias("gap"), F.char_length(mv["m"]).alias("size"), F.char_length(mv["v"]).alias("value")))
    none = F.array().cast("array<struct<start:int,end:int,value:int>>")
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(steps) / CHUNK), F.lit(1)).cast("int") - 1), lambda i: F.slice(steps, i * CHUNK + 1, CHUNK))
    lengths = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda total, s: total + s["gap"] + s["size"]))
    ahead = F.aggregate(lengths, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def step(acc, s):
        at = acc["at"] + s["gap"]
        return F.struct((at + s["size"]).alias("at"), F.concat(acc["out"], F.array(F.struct(at.alias("start"), (at + s["size"]).alias("end"), s["value"].alias("value")))).alias("out"))

    every = F.flatten(F.zip_with(chunks, ahead, lambda c, at: F.aggregate(c, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])))
    kept = F.transform(F.filter(every, lambda s: s["value"] >= rule.min_chars), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return F.when(text.rlike(rule.hint), kept).otherwise(F.array().cast(_SPANS))


def address(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _current(rules: tuple[Rule, ...]) -> str:
    return " or ".join(f"(kind = '{r.kind}' and version = {r.version})" for r in rules)


def new_ledger_rows(history: DataFrame, text_col: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, kind, version, spans) for the pairs of blob and rule version that the ledger lacks; append them to it.

    Of the copies of a blob one text is kept per task before the shuffle, so a blob with many paths is no hot key.
    """
    blobs = history.select(address(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if ledger is not None:
        seen = ledger.where(_current(rules)).groupBy("blob").agg(F.map_from_entries(F.collect_set(F.struct("kind", "version"))).alias("seen"))
        blobs = blobs.join(seen, "blob", "left").where(F.coalesce(F.size("seen"), F.lit(0)) < len(rules))
    else:
        blobs = blobs.withColumn("seen", F.lit(None).cast("map<string,int>"))
    blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"), F.first("seen").alias("seen"))

    def due(r):
        return F.coalesce(F.element_at("seen", F.lit(r.kind)) != r.version, F.lit(True))

    each = [F.when(due(r), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans(F.col("text"), r).alias("spans"))) for r in rules]
    return blobs.select("blob", F.explode(F.filter(F.array(*each), lambda s: s.isNotNull())).alias("f")).select("blob", "f.*")


def _found(rows: DataFrame, known: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """rows (row, blob) with the findings of their blobs, by start and then kind as listed."""
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    found = (
        known.where(F.size("spans") > 0)
        .select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.element_at(rank, F.col("kind")).alias("nth"), s["end"].alias("end"), F.col("kind").alias("kind"))).alias("spans"))
        .groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("found"))
    )
    joined = lookup(cut(rows), "blob", cut(found))
    nothing = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return joined.select("row", F.coalesce(F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))), nothing).alias("found"))


def _rows(history: DataFrame, text_col: str, carry: list[str] | None) -> DataFrame:
    row = F.struct("*") if carry is None else F.struct(*carry)
    return history.select(row.alias("row"), address(F.col(text_col)).alias("blob"))


def scan_history(history: DataFrame, text_col: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, *, carry: list[str] | None = None) -> DataFrame:
    """Each row of history (a path in a version) as struct `row` (with `carry` only those columns), with `found`: its (kind, start, end),
    by start and then kind as listed."""
    known = new_ledger_rows(history, text_col, ledger, rules)
    if ledger is not None:
        known = known.unionByName(ledger.where(_current(rules)).select("blob", "kind", "version", "spans"))
    return _found(_rows(history, text_col, carry), known, rules)


def scan_increments(increments: list[DataFrame], text_col: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, *, carry: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of all increments as scan_history gives them, and the ledger after the last; each increment is scanned against the ledger
    of those before it."""
    rows = None
    for part in increments:
        new = new_ledger_rows(part, text_col, ledger, rules)
        ledger = cut(new if ledger is None else ledger.unionByName(new))
        own = _rows(part, text_col, carry)
        rows = own if rows is None else rows.unionByName(own)
    return _found(rows, ledger.where(_current(rules)), rules), ledger
