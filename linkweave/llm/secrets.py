"""Secret scans with multipart credential linking, in DataFrame functions only.

Base findings are matches of three patterns. Credentials often come in parts that prove little
alone: an access identifier, a secret without any label, an endpoint. Such weak candidates are
collected only in texts with an access identifier, joined by interval with the complementary
parts of the same text, and reported only where those lie within ``SCOPE`` characters:

* ``pair_secret``: a run of exactly 40 characters of the base64 alphabet with upper-case
  letters, lower-case letters and digits, near an access identifier. In a longer run with '='
  (key=value) the value counts, unless it is reported as an assignment already;
* ``pair_endpoint``: a web address near both an access identifier and a secret (an
  assignment or a weak secret).

All positions are found where the text is read; only spans are joined. The interval join is an
equality join on (text, block of SCOPE characters): the narrower side is in one block, the
access identifiers and secrets in all blocks they reach, and since spans do not overlap, a
block holds a bounded number of them. It is a semi join, so no pairs come out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from linkweave.session import cut_lineage

SCOPE = 500


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# What the base kinds look like, in the order in which they are listed.
_KEYWORDS = "|".join([*map(_any_case, ("password", "passwd", "secret", "token")), f"{_any_case('api')}_?{_any_case('key')}"])
ASSIGN = rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{32,}"
# Patterns of the weak candidates.
SECRET = "[A-Za-z0-9+/=]{40,}"
# The same next to a '=' that is not part of it, as in key=value; '=' only ends a value here.
_B = "[A-Za-z0-9+/]"
KEYED = rf"(?<==)(?:{_B}{{40}}(?!{_B})|{_B}{{39}}=(?![A-Za-z0-9+/=])|{_B}{{38}}==(?![A-Za-z0-9+/=]))|(?<!{_B}){_B}{{40}}(?==)"
ENDPOINT = r"""https?://[^\x00-\x20"'<>]+"""
KINDS = ("assign", "access", "hex", "pair_secret", "pair_endpoint")
_SPANS = "array<struct<start:bigint,end:bigint,value:string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once; what a lambda takes from outside is evaluated for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def find_spans(text: Column, pattern: str, group: int = 0, when: str | None = None) -> Column:
    """Leftmost non-overlapping matches: start and end in characters, and the group's text.

    The gaps between the matches and the matches themselves alternate, so their lengths add up to the positions.
    They are added up in blocks, the number of matches to the power of 1/3 in each: first where the blocks start, then
    the spans of every block by itself. An array that grows is copied at every step, and none grows
    beyond a block or the number of blocks. ``when`` is a cheaper pattern without which a text has no match.
    """
    width = lambda x: F.length(x["gap"]) + F.length(x["hit"])
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else None

    def steps(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(hits))
        return F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), (hits if values is None else values).alias("value"))

    def blocks(all_steps: Column) -> Column:
        size = F.greatest(F.lit(16), F.ceil(F.cbrt(F.size(all_steps))).cast("int"))
        last = F.greatest(F.lit(0), F.ceil(F.size(all_steps) / size).cast("int") - 1)
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(all_steps, k * size + 1, size))

    def starts(dealt: Column) -> Column:
        first = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("found"))
        words = lambda block: F.aggregate(block, F.lit(0).cast("bigint"), lambda n, x: n + width(x))
        return F.aggregate(
            F.transform(dealt, words),
            first,
            lambda done, n: F.struct((done["at"] + n).alias("at"), F.concat(done["found"], F.array(done["at"])).alias("found")),
        )["found"]

    def step(done: Column, x: Column) -> Column:
        begin = done["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        span = F.struct(begin.cast("bigint").alias("start"), end.cast("bigint").alias("end"), x["value"].alias("value"))
        return F.struct(end.cast("bigint").alias("at"), F.concat(done["found"], F.array(span)).alias("found"))

    def spans(dealt: Column) -> Column:
        inside = lambda block: F.aggregate(
            block["steps"], F.struct(block["start"].alias("at"), F.array().cast(_SPANS).alias("found")), step
        )["found"]
        return F.flatten(F.transform(F.arrays_zip(dealt.alias("steps"), starts(dealt).alias("start")), inside))

    found = _let(_let(_let(whole, steps), blocks), spans)
    return F.when(F.coalesce(text.rlike(when or pattern), F.lit(False)), found).otherwise(F.array().cast(_SPANS))


def _tagged(spans: str | Column, kind: str) -> Column:
    order = KINDS.index(kind)
    return F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("kind"), s["end"].alias("end"))
    )


def _joined(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, with commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), text), ",")


def _parts(rows: DataFrame, spans: str) -> DataFrame:
    return rows.select("row", F.explode(spans).alias("s")).select("row", F.col("s.start").alias("start"), F.col("s.end").alias("end"))


def _near(weak: DataFrame, strong: DataFrame, scope: int) -> DataFrame:
    """Rows of ``weak`` with a span of ``strong`` at most ``scope`` characters away."""
    block = lambda position: F.floor(position / scope).cast("bigint")
    here = weak.withColumn("block", F.explode(F.sequence(block(F.col("start")), block(F.col("end")))))
    first, last = block(F.col("start") - scope), block(F.col("end") + scope)
    there = strong.select(
        F.col("row").alias("at"), F.col("start").alias("from"), F.col("end").alias("to"), F.explode(F.sequence(first, last)).alias("near")
    )
    same = (F.col("row") == F.col("at")) & (F.col("block") == F.col("near"))
    close = (F.col("from") - F.col("end") <= scope) & (F.col("start") - F.col("to") <= scope)
    return here.join(there, same & close, "left_semi").select("row", "start", "end").distinct()


def _apart(spans: DataFrame, others: DataFrame) -> DataFrame:
    """Rows of ``spans`` that share no character with a span of ``others``, by blocks of ``SCOPE`` characters."""
    block = lambda position: F.floor(position / SCOPE).cast("bigint")
    blocks = lambda: F.explode(F.sequence(block(F.col("start")), block(F.col("end") - 1)))
    there = others.withColumn("block", blocks()).select(
        F.col("row").alias("at"), F.col("start").alias("from"), F.col("end").alias("to"), F.col("block").alias("near")
    )
    same = (F.col("row") == F.col("at")) & (F.col("block") == F.col("near"))
    meet = (F.col("from") < F.col("end")) & (F.col("start") < F.col("to"))
    met = spans.withColumn("block", blocks()).join(there, same & meet, "left_semi").select("row", "start", "end")
    return spans.join(met, ["row", "start", "end"], "left_anti")


def find_secrets(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every row, whole texts.

    Null and empty texts have no spans. Base spans of one kind never overlap, spans of
    different kinds may. A span may be reported under two kinds, and never twice under one.
    Repeated rows each give a row with the same findings; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    long_enough = lambda spans, n: F.filter(spans, lambda s: F.length(s["value"]) >= n)
    mixed = lambda s: (F.length(s["value"]) == 40) & s["value"].rlike("[A-Z]") & s["value"].rlike("[a-z]") & s["value"].rlike("[0-9]")
    has_access = F.size("access") > 0
    nothing = F.array().cast(_SPANS)
    found = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text")).select(
        "doc_id",
        "text",
        long_enough(find_spans(F.col("text"), ASSIGN, 2, f"({_KEYWORDS})"), 8).alias("assign"),
        long_enough(find_spans(F.col("text"), ACCESS, when="AKIA[A-Z0-9]{12}"), 16).alias("access"),
        find_spans(F.col("text"), HEX, when="[0-9a-f]{32}").alias("hex"),
    )
    narrow = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    secret = F.filter(find_spans(F.col("text"), SECRET), mixed)
    keyed = F.filter(find_spans(F.col("text"), KEYED), mixed)
    stored = cut_lineage(
        found.select(
            "doc_id",
            F.concat_ws(":", "doc_id", F.xxhash64("text"), F.hash("text"), F.length("text")).alias("row"),
            *[narrow(F.col(k)).alias(k) for k in ("assign", "access", "hex")],
            narrow(F.when(has_access, secret).otherwise(nothing)).alias("secret"),
            narrow(F.when(has_access, keyed).otherwise(nothing)).alias("keyed"),
            narrow(F.when(has_access, find_spans(F.col("text"), ENDPOINT, when="https?://")).otherwise(nothing)).alias("endpoint"),
        ),
        "spans",
    )
    weak = stored.where((F.size("access") > 0) & (F.size("secret") + F.size("keyed") + F.size("endpoint") > 0))
    weak = weak.dropDuplicates(["row"]).select("row", "access", "assign", "secret", "keyed", "endpoint")
    access, assign = _parts(weak, "access"), _parts(weak, "assign")
    candidates = _parts(weak, "secret").unionByName(_apart(_parts(weak, "keyed"), assign))
    secret = _near(candidates, access, scope)
    endpoint = _near(_parts(weak, "endpoint"), access, scope)
    endpoint = _near(endpoint, assign.unionByName(candidates), scope)
    kind = lambda name: F.lit(KINDS.index(name)).alias("kind")
    linked = (
        secret.select("row", F.struct("start", kind("pair_secret"), "end").alias("s"))
        .unionByName(endpoint.select("row", F.struct("start", kind("pair_endpoint"), "end").alias("s")))
        .groupBy("row")
        .agg(F.collect_list("s").alias("linked"))
    )
    base = F.concat(*[_tagged(F.col(k), k) for k in KINDS[:3]])
    more = F.coalesce("linked", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    return stored.join(linked, "row", "left").select(
        "doc_id",
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.concat(base, more)).alias("spans"),
    )


def _sql_spans(name: str, pattern: str, group: int, keep: str) -> str:
    p = pattern.replace("'", "''")
    return f"""
{name}_m AS (
  SELECT doc_id, regexp_extract_all(t, '{p}', 0) AS hits, regexp_extract_all(t, '{p}', {group}) AS vals, regexp_split_to_array(t, '{p}') AS gaps FROM d
), {name}_u AS (
  SELECT doc_id, i, hits[i] AS hit, vals[i] AS val, gaps[i] AS gap FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM {name}_m)
), {name} AS (
  SELECT doc_id, upto - length(hit) AS s, upto AS e FROM (
    SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM {name}_u
  ) WHERE {keep}
)"""


_CLOSE = f"a.s - w.e <= {SCOPE} AND w.s - a.e <= {SCOPE}"
SECRETS_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_sql_spans('assign', ASSIGN, 2, 'length(val) >= 8')},
{_sql_spans('access', ACCESS, 0, 'length(val) >= 16')},
{_sql_spans('hex', '[0-9a-f]+', 0, 'length(val) >= 32')},
{_sql_spans('whole', '[A-Za-z0-9+/=]{40,}', 0, "length(val) = 40 AND regexp_matches(val, '[A-Z]') AND regexp_matches(val, '[a-z]') AND regexp_matches(val, '[0-9]')")},
{_sql_spans('url', ENDPOINT, 0, 'true')},
{_sql_spans('run', f'{_B}+', 0, 'length(val) BETWEEN 38 AND 40')},
beside AS (
  SELECT r.*, CASE WHEN s > 0 THEN substr(t, s, 1) ELSE '' END AS before, substr(t, e + 1, 3) AS after, t FROM run r JOIN d USING (doc_id)
), valued AS (
  SELECT doc_id, s, s + 40 AS e, substr(t, s + 1, 40) AS val FROM beside
  WHERE (e - s = 40 AND (before = '=' OR after[1] = '='))
     OR (before = '=' AND e - s = 39 AND regexp_matches(after, '^=($|[^A-Za-z0-9+/=])'))
     OR (before = '=' AND e - s = 38 AND regexp_matches(after, '^==($|[^A-Za-z0-9+/=])'))
), weak AS (
  SELECT doc_id, s, e FROM whole
  UNION
  SELECT doc_id, s, e FROM valued v WHERE regexp_matches(val, '[A-Z]') AND regexp_matches(val, '[a-z]') AND regexp_matches(val, '[0-9]')
    AND NOT EXISTS (SELECT 1 FROM assign a WHERE a.doc_id = v.doc_id AND a.s < v.e AND v.s < a.e)
), base AS (
  SELECT doc_id, s, 0 AS k, e, 'assign' AS kind FROM assign UNION ALL SELECT doc_id, s, 1, e, 'access' FROM access
  UNION ALL SELECT doc_id, s, 2, e, 'hex' FROM hex
), linked AS (
  SELECT doc_id, s, 3 AS k, e, 'pair_secret' AS kind FROM weak w WHERE EXISTS (SELECT 1 FROM access a WHERE a.doc_id = w.doc_id AND {_CLOSE})
  UNION ALL
  SELECT doc_id, s, 4, e, 'pair_endpoint' FROM url w WHERE EXISTS (SELECT 1 FROM access a WHERE a.doc_id = w.doc_id AND {_CLOSE})
    AND EXISTS (SELECT 1 FROM (SELECT * FROM assign UNION ALL SELECT * FROM weak) a WHERE a.doc_id = w.doc_id AND {_CLOSE})
), b AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS text
  FROM base GROUP BY doc_id
), a AS (
  SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS text
  FROM (SELECT * FROM base UNION ALL SELECT * FROM linked) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
  coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(b.text, '')) AS base_sha256, coalesce(a.text, '') AS spans
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)
"""
