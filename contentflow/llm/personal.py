"""Personal data: fixed patterns as seeds, and a bootstrap over the words around them.

Seeds are e-mail and IP addresses, card and phone numbers that pass their checks.  Candidates are all other words
with a digit, runs of short groups of digits (one candidate together), and addresses with "at" for the sign.  An instance (the lower-cased string) and a pattern (the two words
before it, or the word before and the word after) are connected where they meet anywhere in the
corpus.  Rounds of Spark joins score the graph: a pattern's confidence in a kind is the sum of the
scores of its instances of that kind over the number of all its instances, plus one; a candidate's
score for a kind is the chance that not all patterns it comes with are wrong.  Patterns need
``SUPPORT`` and ``CONFIDENCE``, candidates ``ACCEPT`` and to be a possible string of the kind (``PLAUSIBLE``), which says
how many digits there are but not how they are parted; the context decides.

Places of matches come from splitting the text by the pattern and extracting its matches: the
lengths of pieces and matches add up to positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from contentflow.session import stage

KINDS = ("email", "ip", "card", "phone")
#: Leftmost matches of the given patterns.  Looking back for a character of the same run only skips starts that
#: cannot match (a run is left whole by the match before, except by an e-mail, whence \G); possessive
#: repetition keeps long runs linear.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_GAP = r"\x20\x09-\x0D"
_GROUP = r"[+(]{0,2}[0-9]{1,6}+\)?(?:-[0-9]{1,6}+)*+"
_RUN = rf"(?<![^{_GAP}]){_GROUP}(?:[{_GAP}]{_GROUP}){{1,5}}+(?![^{_GAP}.,;:!?])"
_AT, _DOT = (rf"[{_GAP}]*[(\[{{<_-]*(?<![A-Za-z0-9])(?i:{w})(?![A-Za-z0-9])[)\]}}>_-]*[{_GAP}]*" for w in ("at", "dot"))
_SPELLED = rf"(?<![^{_GAP}])[A-Za-z0-9._%+-]{{1,64}}?{_AT}[A-Za-z0-9-]++(?:(?:\.|{_DOT})[A-Za-z0-9-]++)++"
_WORD = rf"(?<![^{_GAP}])(?=[^{_GAP}0-9]*+[0-9])[^{_GAP}]++"
CANDIDATE = f"{_RUN}|{_SPELLED}|{_WORD}"
#: Conditions on ``instance`` (lower-case).
_DIGITS, _NUMBER = "length(regexp_replace(instance, '[^0-9]', ''))", "instance RLIKE '^[-+0-9().,:/_ ]+$'"
PLAUSIBLE = {
    "email": "instance RLIKE '[a-z0-9].*(@|(?<![a-z0-9])at(?![a-z0-9])).*[a-z0-9].*([.]|(?<![a-z0-9])dot(?![a-z0-9])).*[a-z]'",
    "ip": f"{_NUMBER} AND {_DIGITS} BETWEEN 4 AND 12 AND instance RLIKE '^([0-9]+[^0-9]+){{3}}[0-9]+$'",
    "card": f"{_NUMBER} AND {_DIGITS} BETWEEN 12 AND 19",
    "phone": f"{_NUMBER} AND {_DIGITS} BETWEEN 7 AND 15",
}
ROUNDS, SUPPORT, CONFIDENCE, ACCEPT = 3, 3, 0.6, 0.6
_SPAN = "array<struct<start:int,ord:int,end:int,kind:string,value:string,left:string,right:string>>"


def _checked(kind: str) -> str:
    """SQL condition on the string ``x.value``."""
    digits = "regexp_replace(x.value, '[^0-9]', '')"
    return {
        "email": "true",
        "ip": "forall(split(x.value, '[.]'), p -> length(trim(LEADING '0' FROM p)) <= 3 "
        "AND coalesce(try_cast(trim(LEADING '0' FROM p) AS int), 0) <= 255)",
        "card": f"length({digits}) BETWEEN 12 AND 19 AND luhn_check({digits})",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
    }[kind]


def _places(pieces: str, matches: str, kind: str, rank: int) -> Column:
    """Spans of the matches between the pieces, with up to 64 characters on either side."""
    return F.expr(f"""
      aggregate(
        zip_with(zip_with(slice({pieces}, 1, size({matches})), {matches}, (p, m) -> named_struct('p', p, 'm', m)),
          slice({pieces}, 2, size({matches})), (a, r) -> named_struct('p', a.p, 'm', a.m, 'r', r)),
        named_struct('at', 0, 'out', cast(array() AS {_SPAN})),
        (s, x) -> named_struct('at', s.at + length(x.p) + length(x.m), 'out', concat(s.out, array(named_struct(
          'start', s.at + length(x.p), 'ord', {rank}, 'end', s.at + length(x.p) + length(x.m), 'kind', '{kind}', 'value', x.m,
          'left', right(x.p, 64), 'right', left(x.r, 64))))),
        s -> s.out)""")


def _matched(df: DataFrame, text: str, pattern: str, name: str, needs: Column) -> DataFrame:
    """``df`` with the spans ``name`` of ``pattern`` in column ``text``; only texts that pass ``needs`` are searched."""
    none = F.array().cast("array<string>")
    p, m = f"{name}_p", f"{name}_m"
    df = df.withColumn(p, F.when(needs, F.split(text, pattern, -1)).otherwise(none))
    df = df.withColumn(m, F.when(F.size(p) > 1, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    rank = KINDS.index(name) if name in KINDS else len(KINDS)
    return df.withColumn(name, _places(p, m, name, rank)).drop(p, m)


def _rewritten(text: str, spans: str, fill: str) -> Column:
    """``text`` with every stretch of ``spans`` (sorted, may overlap) replaced by ``fill``, an expression of span ``x`` and its ``skip``ped length."""
    return F.expr(f"""
      aggregate({spans}, named_struct('at', 0, 'out', cast(array() AS array<string>)),
        (s, x) -> named_struct('at', greatest(s.at, x.end), 'out', concat(s.out, array(
          substring({text}, s.at + 1, greatest(x.start - s.at, 0)),
          CASE WHEN x.end > s.at THEN {fill} ELSE '' END))),
        s -> concat(array_join(s.out, ''), substring({text}, s.at + 1)))""")


def _words(column: str) -> tuple[Column, Column]:
    """The last word before and the last two words before, from 64 characters of context."""
    low = F.lower(F.col(column))
    last = rf"([^{_GAP}]+)[{_GAP}]*$"
    two = rf"([^{_GAP}]+[{_GAP}]+[^{_GAP}]+)[{_GAP}]*$"
    return F.regexp_extract(low, last, 1), F.regexp_replace(F.regexp_extract(low, two, 1), rf"[{_GAP}]+", " ")


def _edges(spans: DataFrame) -> DataFrame:
    """Distinct ``pattern, instance, kind`` of rows ``kind`` (null: candidate), ``value, left, right``."""
    one, two = _words("left")
    after = F.regexp_extract(F.lower("right"), rf"^[{_GAP}]*([^{_GAP}]+)", 1)
    pattern = F.explode(
        F.filter(
            F.array(F.when(two != "", F.concat(two, F.lit(" _"))), F.when((one != "") & (after != ""), F.concat(one, F.lit(" _ "), after))),
            lambda p: p.isNotNull(),
        )
    )
    return spans.select(pattern.alias("pattern"), F.lower("value").alias("instance"), "kind").distinct()


def discovered(spans: DataFrame) -> DataFrame:
    """``instance, kind, score`` of the candidates that the bootstrap accepts, from rows ``kind, value, left, right``."""
    edges = stage(_edges(spans), "edges")
    plausible = F.expr("CASE kind " + " ".join(f"WHEN '{k}' THEN {x}" for k, x in PLAUSIBLE.items()) + " END")
    known = edges.where("kind IS NOT NULL").select("pattern", "instance", "kind", F.lit(1.0).alias("score"))
    open_ = edges.where("kind IS NULL").select("pattern", "instance")
    size = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("all"))
    size = stage(size.where(f"all >= {SUPPORT}"), "patterns")
    found = None
    for _ in range(ROUNDS):
        sums = known.groupBy("pattern", "kind").agg(F.sum("score").alias("s")).where(F.col("s") >= SUPPORT)
        sure = sums.join(size, "pattern").select("pattern", "kind", (F.col("s") / (F.col("all") + 1)).alias("confidence"))
        sure = sure.where(F.col("confidence") >= CONFIDENCE)
        met = open_.join(sure, "pattern").groupBy("instance", "kind")
        score = met.agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score")).where(F.col("score") >= ACCEPT)
        score = score.where(plausible)
        best = score.groupBy("instance").agg(F.max(F.struct("score", "kind")).alias("b"))
        found = stage(best.select("instance", "b.kind", "b.score"), "found")
        known = known.where("score = 1.0").unionByName(open_.join(found, "instance").select("pattern", "instance", "kind", "score"))
    return found


def annotated(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Rows ``row`` (the columns ``keep`` of ``docs``), ``base`` and ``more``: sorted arrays of spans by fixed patterns and by the bootstrap.

    Spans have ``start``, ``end`` (code points) and ``kind``.  A null or empty text has none.  Rows stand for
    themselves; copies add no weight, as the graph counts distinct strings.
    """
    row = F.struct(*[docs[f"`{c}`"] for c in keep]).alias("row")
    df = docs.select(row, F.coalesce("text", F.lit("")).alias("text"))
    digit = F.col("text").rlike("[0-9]")
    for kind, pattern in PATTERNS.items():
        needs = F.contains(F.col("text"), F.lit(NEEDS[kind])) & (digit if kind != "email" else F.lit(True))
        df = _matched(df, "text", pattern, kind, needs)
    checked = [f"filter({k}, x -> {_checked(k)})" for k in KINDS]
    df = df.select("row", "text", F.array_sort(F.expr(f"concat({', '.join(checked)})")).alias("base"))
    masked = _rewritten("text", "base", "repeat('x', x.end - greatest(s.at, x.start))")
    df = df.select("row", "base", masked.alias("masked"))
    df = _matched(df, "masked", CANDIDATE, "candidate", F.col("masked").rlike(rf"[0-9]|{_AT}"))
    lead, core = "length(regexp_extract(x.value, '^[^A-Za-z0-9+]*', 0))", "regexp_replace(x.value, '^[^A-Za-z0-9+]+|[^A-Za-z0-9]+$', '')"
    trimmed = F.expr(f"transform(candidate, x -> named_struct('start', x.start + {lead}, 'value', {core}, 'left', x.left, 'right', x.right))")
    df = df.select("row", "base", trimmed.alias("open"), F.monotonically_increasing_id().alias("uid"))
    # Written once: the running numbers have to stay as they are.
    df = stage(df, "annotated")
    seeds = df.select(F.explode("base").alias("x")).select("x.kind", "x.value", "x.left", "x.right")
    open_ = df.select("uid", F.explode("open").alias("x")).select("uid", "x.*")
    found = discovered(seeds.unionByName(open_.select(F.lit(None).cast("string").alias("kind"), "value", "left", "right")))
    hits = open_.join(found, F.lower("value") == F.col("instance"))
    ranks = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    span = F.struct("start", ranks[F.col("kind")].alias("ord"), (F.col("start") + F.length("value")).alias("end"), "kind")
    hits = hits.groupBy("uid").agg(F.array_sort(F.collect_list(span)).alias("more"))  # at most one per word of a row
    none = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")
    base = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["ord"].alias("ord"), x["end"].alias("end"), x["kind"].alias("kind")))
    return df.join(hits, "uid", "left").select("row", base.alias("base"), F.coalesce("more", none).alias("more"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _all_spans() -> Column:
    return F.array_sort(F.concat("base", "more"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; ``n_chars``, if there, is counted anew.  Null texts stay null."""
    df = annotated(docs, docs.columns).select("row", F.col("row.text").alias("text"), _all_spans().alias("spans"))
    df = df.withColumn("text", F.when(F.size("spans") > 0, _rewritten("text", "spans", "concat('[', upper(x.kind), ']')")).otherwise(F.col("text")))
    kind = dict(docs.dtypes)
    new = {"text": F.col("text"), "n_chars": F.coalesce(F.length("text"), F.col("row.n_chars") if "n_chars" in kind else F.lit(0))}
    return df.select(*[(new[c].cast(kind[c]) if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op3_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    df = annotated(docs, ["doc_id"])
    of = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return df.select(
        "row.doc_id", *[of(k) for k in KINDS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(_all_spans()).alias("spans")
    )
