"""All queries of the core over the tables of a data directory, and the SQL that they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions import patterns as P
from foliospark.functions import text as X
from foliospark.functions.python import nfkc, splice_paragraphs
from foliospark.operators import assess as A
from foliospark.operators import compare as C
from foliospark.operators import labels as L
from foliospark.operators import lines as N
from foliospark.operators import manifest as M
from foliospark.operators import paragraphs as G
from foliospark.operators import sampling as S
from foliospark.operators import variants as V
from foliospark.session import cut_lineage
from foliospark.sources import files, jats
from foliospark.sources.tables import table

SEED = 20261004
PAGE_LINES = 12


# ---------------------------------------------------------------- inputs


def _segments(spark: SparkSession, d: str) -> DataFrame:
    """The segments, each once: of several deliveries the greatest row."""
    s = table(spark, d, "segments")
    cols = ["kind", "text", "section", "page", "loc"]
    # A map can't be compared: its sorted entries stand in for it.
    entries = F.array_sort(F.map_entries("traces"))
    one = s.groupBy("doc_id", "seg_order").agg(F.max(F.struct(*cols, entries.alias("entries"))).alias("m"))
    return one.select("doc_id", "seg_order", *[f"m.{c}" for c in cols], F.map_from_entries("m.entries").alias("traces"))


def _pages(spark: SparkSession, d: str, size: int = PAGE_LINES) -> DataFrame:
    """Documents as pages of a dozen lines each; a document without text is a failed page."""
    t = table(spark, d, "documents").select("doc_id", X.lines(F.col("text")).alias("l"))
    p = t.select("doc_id", F.posexplode_outer(F.expr(f"transform(sequence(0, (size(l) - 1) div {size}), i -> array_join(slice(l, i * {size} + 1, {size}), '\\n'))")).alias("i", "text"))
    return p.select("doc_id", (F.coalesce("i", F.lit(0)) + 1).alias("page"), "text")


def _framed_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of three lines, each with a header and a page number, and in every fifth document a line of broken glyphs."""
    header, number = F.concat(F.lit("Notes on Plants "), (F.col("doc_id") % 7).cast("string"), F.lit(", "), F.col("page").cast("string")), (F.col("page") + F.col("doc_id") % 5).cast("string")
    glyphs = F.when(F.col("doc_id") % 5 == 0, "as de\ue103ned at 40 /C14 C\n").otherwise("")
    return _pages(spark, d, 3).where("text IS NOT NULL").select("doc_id", "page", F.concat(header, F.lit("\n"), glyphs, F.col("text"), F.lit("\n"), number).alias("text"))


def _plain_lines(spark: SparkSession, d: str, framed: bool = False) -> DataFrame:
    """Lines without NFKC, as SQL can't normalise."""
    pages = _framed_pages(spark, d) if framed else _pages(spark, d)
    return cut_lineage(N.mark_edges(N.strip_line_numbers(N.split_pages(pages, normalise=False))))


def _read_segments(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return G.read_pages(_pages(spark, d))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "label_records")
    return r.withColumn("line_no", F.concat_ws("|", "doc_id", F.coalesce("bundle_id", F.lit("")), F.coalesce("notes", F.lit(""))))


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tasks").distinct()


# ---------------------------------------------------------------- queries

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return register


_STOP = "(" + ", ".join(f"'{w}'" for w in P.STOPWORDS) + ")"
_FOREIGN = "(" + ", ".join(f"'{w}'" for w in P.FOREIGN_WORDS) + ")"
#: All white space of Unicode, for RE2.
_SP = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_LET = r"\p{L}\p{Nl}\p{No}"


def _n(text: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({text}, '{pattern}')) AS BIGINT)"


def _strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^[{_SP}]+', ''), '[{_SP}]+$', '')"


_PLAIN = "replace(coalesce(text, ''), '[FORMULA]', ' ')"
_WORDS = _n(_PLAIN, "[A-Za-z][A-Za-z\\-'']*")
_TOKENS = f"regexp_extract_all({_PLAIN}, '[{_LET}]+')"

_GATE = f"""
WITH t AS (SELECT doc_id, lang, {_WORDS} AS words, {_TOKENS} AS tk FROM documents),
m AS (SELECT doc_id, lang, words, CAST(len(tk) AS BIGINT) AS tokens,
  CAST(len(list_filter(tk, lambda x: regexp_matches(x, '[^\\x00-\\x7f]'))) AS BIGINT) AS non_latin,
  CAST(len(list_filter(tk, lambda x: lower(x) IN {_STOP})) AS BIGINT) AS stop,
  CAST(len(list_filter(tk, lambda x: lower(x) IN {_FOREIGN})) AS BIGINT) AS "foreign" FROM t),
s AS (SELECT *, CASE WHEN tokens = 0 THEN 'extraction_failed'
  WHEN non_latin / greatest(tokens, 1) > 0.3 OR stop / greatest(tokens, 1) < 0.04 OR "foreign" / greatest(tokens, 1) > 0.05 THEN 'out_of_scope'
  WHEN words < 300 THEN 'too_short' ELSE 'completed' END AS status FROM m)
"""


def _gate(spark, d):
    t = A.measured(table(spark, d, "documents").select("doc_id", "lang", "text")).drop("text")
    return t.withColumn("status", A.status())


@query(_GATE + "SELECT lang, status, count(*) AS n, CAST(sum(words) AS BIGINT) AS words FROM s GROUP BY lang, status")
def scope_gate(spark, d):
    return _gate(spark, d).groupBy("lang", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words"))


@query(_GATE + 'SELECT doc_id, words, tokens, non_latin, stop, "foreign", status FROM s')
def document_status(spark, d):
    return _gate(spark, d).drop("lang")


# The patterns of notation traces, for RE2.
_TRACE_SQL = {k: v for k, v in (("unicode_subsup", "[⁰-₟²³¹]"), ("latex", r"\$[^$\n]{0,60}?[_^][^$\n]{0,60}?\$|\\[(\[]|[_^]\{[^}\n]{1,20}\}|\\(?:mathrm|text|frac|cdot|times)\b"), ("markup", r"</?su[bp]>|~\d{1,3}~|\^\d{1,3}\^"))}
_ONE_SEGMENT = "seg AS (SELECT doc_id, seg_order, max(struct_pack(kind := kind, text := text, section := section, page := page, loc := loc)) AS m FROM segments GROUP BY 1, 2)"


@query("SELECT DISTINCT doc_id, seg_order, " + ", ".join(f"{_n('text', p)} AS {k}" for k, p in _TRACE_SQL.items()) + " FROM segments WHERE text IS NOT NULL")
def trace_counts(spark, d):
    t = X.format_traces(F.col("text"))
    s = table(spark, d, "segments").where("text IS NOT NULL")
    return s.select("doc_id", "seg_order", *[F.coalesce(F.try_element_at(t, F.lit(k)), F.lit(0)).cast("long").alias(k) for k in P.TRACES]).distinct()


@query(
    f"WITH {_ONE_SEGMENT} SELECT doc_id, "
    + ", ".join(f"count(*) FILTER (WHERE m.kind = '{k}') AS n_{k}" for k in P.KINDS)
    + f", CAST(coalesce(sum({_WORDS.replace('text', 'm.text')}) FILTER (WHERE m.kind = 'body'), 0) AS BIGINT) AS body_words, CAST(coalesce(sum(len(regexp_extract_all(m.text, '\\[FORMULA\\]'))) FILTER (WHERE m.kind = 'body'), 0) AS BIGINT) AS placeholders FROM seg GROUP BY doc_id"
)
def segment_summary(spark, d):
    s = A.summarize(_segments(spark, d))
    return s.select("doc_id", *[f"n_{k}" for k in P.KINDS], "body_words", "placeholders")


@query(
    """WITH e AS (SELECT DISTINCT doc_id, seg_order, kind, unnest(map_entries(traces)) AS e FROM segments WHERE traces IS NOT NULL)
SELECT doc_id, e.key AS trace, CAST(sum(e.value) AS BIGINT) AS n, CAST(coalesce(sum(e.value) FILTER (WHERE kind = 'body'), 0) AS BIGINT) AS n_body FROM e GROUP BY 1, 2"""
)
def trace_sums(spark, d):
    s = table(spark, d, "segments").select("doc_id", "seg_order", "kind", F.explode("traces").alias("trace", "n")).distinct()
    return s.groupBy("doc_id", "trace").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("kind") == "body", F.col("n"))), F.lit(0)).alias("n_body"))


_NUM = r"^[(\[]?[-−+]?\d[\d.,:/×%−-]*[)\]]?$"
_EQ_WORDS = f"regexp_matches({_PLAIN}, '=.*\\(\\d{{1,3}}[a-z]?\\)[{_SP}]*$')"
_CHUNKS = f"list_filter(regexp_split_to_array(text, '[{_SP}]+'), lambda x: x <> '')"


@query(
    f"""WITH {_ONE_SEGMENT}, b AS (SELECT doc_id, m.text AS text FROM seg WHERE m.kind = 'body' AND m.text IS NOT NULL),
p AS (SELECT doc_id, {_WORDS} AS n, NOT regexp_matches(text, '[.?!:;)\\]"'']$') AS open_end, regexp_matches(text, '^\\p{{Ll}}') AS small, regexp_matches(text, '^\\d') AS digit,
  len(list_filter({_CHUNKS}, lambda x: regexp_matches(x, '{_NUM}'))) >= 0.2 * greatest(len({_CHUNKS}), 1) AS numbers FROM b)
SELECT doc_id, count(*) FILTER (WHERE n < 10) AS under_10, count(*) FILTER (WHERE n BETWEEN 10 AND 29) AS from_10, count(*) FILTER (WHERE n BETWEEN 30 AND 79) AS from_30,
  count(*) FILTER (WHERE n BETWEEN 80 AND 199) AS from_80, count(*) FILTER (WHERE n >= 200) AS from_200, list_sort(list(n))[count(*) // 2 + 1] AS median_words,
  count(*) FILTER (WHERE open_end) AS open_end, count(*) FILTER (WHERE small) AS starting_small, count(*) FILTER (WHERE digit) AS starting_digit, count(*) FILTER (WHERE numbers) AS mostly_numbers FROM p GROUP BY doc_id"""
)
def paragraph_shape(spark, d):
    keep = ["doc_id", "under_10", "from_10", "from_30", "from_80", "from_200", "median_words", "open_end", "starting_small", "starting_digit", "mostly_numbers"]
    return A.inspect(_segments(spark, d)).select(*keep)


@query()
def paragraph_inspection(spark, d):
    return A.inspect(_segments(spark, d))


@query(
    f"SELECT doc_id, substr(sha256(text), 1, 16) AS sha16, {_n('text', '[ﬀ-ﬆ]')} AS ligatures, {_n('text', '\\*\\*')} AS bold, "
    + r"CAST(len(regexp_extract_all(text, '\b(?:[A-Z][a-z]?\d+)+(?:[A-Z][a-z]?\d*)*\b')) AS BIGINT) AS plain_formulas, "
    + f"CAST(len(regexp_extract_all({_PLAIN}, '[A-Za-z0-9]+')) AS BIGINT) AS tokens, CAST(len(list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: regexp_matches(x, '^[A-Z][A-Za-z]*[0-9][A-Za-z0-9]*$')))) AS BIGINT) AS chemicals FROM documents WHERE text IS NOT NULL"
)
def text_statistics(spark, d):
    t = F.col("text")
    s = table(spark, d, "documents").where("text IS NOT NULL")
    return s.select(
        "doc_id", F.substr(F.sha2(F.encode(t, "UTF-8"), 256), F.lit(1), F.lit(16)).alias("sha16"), X.count(t, P.LIGATURE).alias("ligatures"), X.count(t, r"\*\*").alias("bold"), X.count(t, P.PLAIN_FORMULA).alias("plain_formulas"), F.size(X.tokens(t)).cast("long").alias("tokens"), F.size(X.chemical_tokens(t)).cast("long").alias("chemicals")
    )


@query()
def broken_glyphs(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.broken_glyphs(F.col("text")).alias("broken"), X.repair_glyphs(F.col("text"))[1].alias("repairs"))


@query()
def normalised_text(spark, d):
    return table(spark, d, "documents").select("doc_id", nfkc(F.col("text")).alias("text"))


_REPAIRED = "raw"
for _bad, _good in P.LIGATURES.items():
    _REPAIRED = f"replace(regexp_replace({_REPAIRED}, '([A-Za-z]) ?{_bad} ?([a-z])', '\\1{_good}\\2', 'g'), '{_bad}', '{_good}')"
for _bad, _good in P.SYMBOLS.items():
    _REPAIRED = f"replace({_REPAIRED}, '{_bad}', '{_good}')"
_REPAIRED = f"CASE WHEN bool_or(regexp_matches(raw, '{P.GLYPH_SIGNATURE}')) OVER (PARTITION BY doc_id, page) THEN {_REPAIRED} ELSE raw END"

_PAGES = rf"""
WITH l00 AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) AS raw, unnest(range(len(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
l0 AS (SELECT doc_id, CAST(i // {PAGE_LINES} + 1 AS INT) AS page, CAST(i % {PAGE_LINES} AS INT) AS line, raw FROM l00),
l1 AS (SELECT doc_id, page, line, raw, {_strip('raw')} AS x, regexp_extract(raw, '^[{_SP}]*(\d{{1,4}})[{_SP}]+[^{_SP}]', 1) AS num FROM (SELECT doc_id, page, line, {_REPAIRED} AS raw FROM l0)),
l2 AS (SELECT *, CASE WHEN x <> '' AND num <> '' THEN CAST(num AS INT) END AS n FROM l1),
l3 AS (SELECT *, n - last_value(n IGNORE NULLS) OVER (PARTITION BY doc_id, page ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS step FROM l2),
l4 AS (SELECT *, count(*) FILTER (WHERE x <> '') OVER p >= 10 AND count(n) OVER p >= 0.7 * count(*) FILTER (WHERE x <> '') OVER p AND count(*) FILTER (WHERE step = 1) OVER p >= 0.8 * (count(n) OVER p - 1) AS numbered FROM l3 WINDOW p AS (PARTITION BY doc_id, page)),
l5 AS (SELECT doc_id, page, line, raw, numbered, CASE WHEN numbered THEN regexp_replace(raw, '^[{_SP}]*\d{{1,4}}[{_SP}]+([^{_SP}])', '\1') ELSE raw END AS text FROM l4),
l6 AS (SELECT *, {_strip('text')} AS x, regexp_replace(lower(text), '[\d{_SP}]+', '', 'g') AS key FROM l5),
l7 AS (SELECT *, x <> '' AND (count(*) FILTER (WHERE x <> '') OVER (PARTITION BY doc_id, page ORDER BY line) <= 2 OR count(*) FILTER (WHERE x <> '') OVER (PARTITION BY doc_id, page ORDER BY line) > count(*) FILTER (WHERE x <> '') OVER (PARTITION BY doc_id, page) - 2) AS edge FROM l6)
"""


# The same with framed pages.
_PAGE = f"CAST(i // {PAGE_LINES} + 1 AS INT) AS page, CAST(i % {PAGE_LINES} AS INT) AS line"
_FRAMED = _PAGES.replace(f"l0 AS (SELECT doc_id, {_PAGE}, raw FROM l00),", """lp AS (SELECT doc_id, CAST(i // 3 + 1 AS INT) AS page, CAST(i % 3 + CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS INT) AS line, raw FROM l00),
l0 AS (SELECT doc_id, page, line, raw FROM lp UNION ALL SELECT DISTINCT doc_id, page, 0, 'Notes on Plants ' || (doc_id % 7) || ', ' || page FROM lp
  UNION ALL SELECT DISTINCT doc_id, page, 1, 'as de\ue103ned at 40 /C14 C' FROM lp WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, page, CAST(max(line) + 1 AS INT), CAST(page + doc_id % 5 AS VARCHAR) FROM lp GROUP BY 1, 2),""")


@query(_PAGES + "SELECT doc_id, page, line, numbered, edge FROM l7")
def line_marks(spark, d):
    return _plain_lines(spark, d).select("doc_id", "page", "line", "numbered", "edge")


_RUNNING = """, np AS (SELECT doc_id, count(DISTINCT page) AS pages FROM l7 GROUP BY 1),
rk AS (SELECT k.doc_id, k.key FROM (SELECT doc_id, key, count(DISTINCT page) AS n FROM l7 WHERE edge AND key <> '' GROUP BY 1, 2) k JOIN np USING (doc_id) WHERE pages >= 3 AND n >= greatest(3, pages // 2)),
po0 AS (SELECT doc_id, CAST(x AS INT) - page AS shift, count(*) AS n, min(page * 100000 + line) AS pos FROM l7 WHERE edge AND regexp_matches(x, '^[0-9]{1,4}$') GROUP BY 1, 2),
po AS (SELECT doc_id, shift FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS r FROM po0) WHERE r = 1 AND n >= 3),
kept AS (SELECT l7.* FROM l7 LEFT JOIN rk ON rk.doc_id = l7.doc_id AND rk.key = l7.key LEFT JOIN po ON po.doc_id = l7.doc_id
  WHERE NOT (edge AND (rk.key IS NOT NULL OR coalesce(x = CAST(page + shift AS VARCHAR), false))))"""


@query(_FRAMED + _RUNNING + " SELECT doc_id, key FROM rk")
def running_lines(spark, d):
    return N.running_keys(_plain_lines(spark, d, framed=True))


@query(_FRAMED + _RUNNING + " SELECT doc_id, CAST(shift AS INT) AS shift FROM po")
def page_number_shift(spark, d):
    return N.page_offsets(_plain_lines(spark, d, framed=True))


@query(_FRAMED + _RUNNING + " SELECT doc_id, page, line, text FROM kept")
def kept_lines(spark, d):
    return N.drop_running(_plain_lines(spark, d, framed=True)).select("doc_id", "page", "line", "text")


_REFS = rf""", rf AS (SELECT doc_id, min(page * 100000 + line) AS pos FROM kept WHERE regexp_matches(text, '(?i)^[{_SP}]*(\d+\.?[{_SP}]*)?(references|bibliography|literature\s+cited|참고\s*문헌)[{_SP}]*$') GROUP BY 1),
parts AS (SELECT kept.*, CASE WHEN pos IS NULL OR page * 100000 + line < pos THEN 'body' WHEN page * 100000 + line = pos THEN 'title' ELSE 'reference' END AS part FROM kept LEFT JOIN rf USING (doc_id))"""


_BROKEN = r"[\p{Co}�□\x00-\x08\x0b\x0e-\x1f\x7f-\x{9f}]"  # BROKEN_GLYPH without unassigned characters, which RE2 can't name
_SIGNS = "+".join(_n("raw", x) for x in (*P.LIGATURES, *P.SYMBOLS))


@query(
    _FRAMED + _RUNNING + _REFS + f""", gl AS (SELECT doc_id, page, CAST(sum({_SIGNS}) AS BIGINT) AS n FROM l0 GROUP BY 1, 2 HAVING bool_or(regexp_matches(raw, '{P.GLYPH_SIGNATURE}')))
SELECT doc_id, 'glyphs_repaired' AS code, CAST(sum(n) AS BIGINT) AS n FROM gl GROUP BY 1
UNION ALL SELECT doc_id, 'glyphs_broken', n FROM (SELECT doc_id, CAST(sum({_n('text', _BROKEN)}) AS BIGINT) AS n FROM l7 GROUP BY 1) WHERE n > 0
UNION ALL SELECT doc_id, 'numbered_pages', count(DISTINCT page) FROM l7 WHERE numbered GROUP BY 1
UNION ALL SELECT doc_id, 'running_lines', count(*) FROM rk GROUP BY 1
UNION ALL SELECT doc_id, 'page_numbers', 1 FROM po
UNION ALL SELECT DISTINCT doc_id, 'references_not_found', 1 FROM l7 WHERE doc_id NOT IN (SELECT doc_id FROM rf)"""
)
def line_issues(spark, d):
    return N.line_issues(_framed_pages(spark, d), _plain_lines(spark, d, framed=True))


@query()
def page_issues(spark, d):
    pages = _pages(spark, d)
    seg, lines = G.read_pages(pages)
    return N.line_issues(pages, lines).unionByName(A.segment_issues(seg, N.failed_pages(pages)))


@query(_PAGES + _RUNNING + _REFS + " SELECT doc_id, page, line, part FROM parts")
def line_parts(spark, d):
    return N.split_references(N.drop_running(_plain_lines(spark, d))).select("doc_id", "page", "line", "part")


_MATH = "(" + ", ".join(f"'{w}'" for w in P.MATH_WORDS) + ")"
_VERBS = "|".join(P.FINITE_VERBS)
_TAILS = "|".join(P.TRAILING_WORDS)
_BACKS = "|".join(P.BACK_SECTIONS)
_PREFIX = rf"^(\d{{1,2}}(\.\d{{1,2}}){{0,3}}\.?|[IVX]{{1,4}}\.)[{_SP}]+"
_BARE = f"regexp_replace(x, '{_PREFIX}', '')"
_NAMED = f"(regexp_matches({_BARE}, '(?i)^({'|'.join(P.NAMED_SECTIONS)})[{_SP}]*:?[{_SP}]*$') OR regexp_matches(regexp_replace({_BARE}, '[ :]+$', ''), '(?i)^({_BACKS})$') OR (regexp_matches({_BARE}, '(?i)^({_BACKS})\\b') AND len(regexp_extract_all({_BARE}, '[A-Za-z][A-Za-z\\-'']*')) <= 4 AND NOT regexp_matches({_BARE}, '[.;,]$')))"
_XW = "regexp_extract_all(replace(x, '[FORMULA]', ' '), '[A-Za-z][A-Za-z\\-'']*')"
_REST = f"regexp_replace(x, '^[{_SP}]*[^{_SP}]+[{_SP}]+', '')"
_HEADX = f"(len({_XW}) > 0 AND ({_NAMED} OR (len({_XW}) <= 10 AND regexp_matches(x, '^(\\d{{1,2}}(\\.\\d{{1,2}}){{0,3}}\\.?|[IVX]{{1,4}}\\.)[{_SP}]+[A-Z][^.!?]{{0,80}}$') AND NOT regexp_matches({_REST}, '(?i)\\b({_VERBS})\\b') AND NOT regexp_matches({_REST}, '(?i)\\b({_TAILS})[{_SP}]*$') AND len(list_filter(regexp_split_to_array({_REST}, '[{_SP}]+'), lambda c: regexp_matches(c, '{_NUM}'))) < 2)))"
_EQX = f"(regexp_matches(x, '=.*\\(\\d{{1,3}}[a-z]?\\)[{_SP}]*$') AND len(list_filter({_XW}, lambda w: len(w) >= 4 AND NOT (upper(w) = w) AND lower(w) NOT IN {_MATH})) = 0)"
_CAP = rf"^(Fig\.?|Figure|Scheme|Table|FIG\.?|FIGURE|SCHEME|TABLE)[{_SP}]*(\d+|[IVX]+)[.:]?[{_SP}]+[A-Z(]"
_FOLD = f"""
, f0 AS (SELECT doc_id, page, part, line, 0 AS sub, x FROM parts WHERE part <> 'title'),
f1 AS (SELECT *, row_number() OVER w AS i, lag(x) OVER w AS prev, {_EQX} AS eq, {_NAMED} AS named,
  {_HEADX} AND NOT coalesce(regexp_matches(first_value(CASE WHEN x <> '' THEN x END IGNORE NULLS) OVER (PARTITION BY doc_id, page, part ORDER BY line, sub ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '^\\p{{Ll}}'), false) AS head
  FROM f0 WINDOW w AS (PARTITION BY doc_id, page, part ORDER BY line, sub)),
f2 AS (SELECT *, eq OR (head AND (prev IS NULL OR prev = '' OR coalesce(lag(eq) OVER w, false) OR regexp_matches(prev, '[.:?!;]$') OR named)) AS sure FROM f1 WINDOW w AS (PARTITION BY doc_id, page, part ORDER BY i)),
f3 AS (SELECT *, coalesce(max(CASE WHEN sure THEN i END) OVER w >= coalesce(max(CASE WHEN NOT head THEN i END) OVER w, -1), false) AS alone FROM f2 WINDOW w AS (PARTITION BY doc_id, page, part ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
f4 AS (SELECT *, x <> '' AND (alone OR prev IS NULL OR prev = '' OR coalesce(lag(alone) OVER w, false) OR regexp_matches(x, '{_CAP}') OR (regexp_matches(prev, '[.:?!]$') AND regexp_matches(x, '^[A-Z0-9(\\[]'))) AS begins FROM f3 WINDOW w AS (PARTITION BY doc_id, page, part ORDER BY i)),
f5 AS (SELECT *, NOT begins AND suffix(prev, '-') AND regexp_matches(x, '^[a-z]') AS closed, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER w AS pid FROM f4 WINDOW w AS (PARTITION BY doc_id, page, part ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
f6 AS (SELECT *, CASE WHEN begins OR closed THEN '' ELSE ' ' END || CASE WHEN coalesce(lead(closed) OVER (PARTITION BY doc_id, page, part ORDER BY i), false) THEN left(x, len(x) - 1) ELSE x END AS piece FROM f5),
paras AS (SELECT doc_id, page, part, min(line) AS first, max(line) AS last, string_agg(piece, '' ORDER BY i) AS x FROM f6 WHERE x <> '' GROUP BY doc_id, page, part, pid)
"""


@query(_PAGES + _RUNNING + _REFS + _FOLD + "SELECT doc_id, page, part, first, last, x AS text FROM paras")
def paragraphs(spark, d):
    p = G.fold_paragraphs(N.split_references(N.drop_running(_plain_lines(spark, d))).where("part <> 'title'").withColumn("sub", F.lit(0)))
    return p.select("doc_id", "page", "part", "first", "last", "text")


_NUMERIC_CHUNKS = f"len(list_filter(regexp_split_to_array(x, '[{_SP}]+'), lambda c: regexp_matches(c, '{_NUM}')))"
_STOPS = f"len(list_filter(regexp_extract_all(regexp_replace(x, '\\([a-z]\\)', ' ', 'g'), '[A-Za-z][A-Za-z\\-'']*'), lambda w: lower(w) IN {_STOP}))"


@query(
    _PAGES + _RUNNING + _REFS + _FOLD
    + f"""SELECT doc_id, page, first, last, CASE WHEN part = 'reference' THEN 'reference' WHEN regexp_matches(x, '{_CAP}') THEN CASE WHEN upper(regexp_extract(x, '{_CAP}', 1)) = 'TABLE' THEN 'table' ELSE 'caption' END
  WHEN first = last AND {_EQX} THEN 'formula' WHEN first = last AND {_HEADX} THEN 'heading' END AS kind FROM paras
  WHERE part = 'reference' OR regexp_matches(x, '{_CAP}') OR (first = last AND ({_EQX} OR {_HEADX}))"""
)
def structural_paragraphs(spark, d):
    p = G.fold_paragraphs(N.split_references(N.drop_running(_plain_lines(spark, d))).where("part <> 'title'").withColumn("sub", F.lit(0)))
    kind = F.when(F.col("part") == "reference", "reference").otherwise(G.paragraph_kind(F.col("text"), F.col("first") == F.col("last")))
    return p.select("doc_id", "page", "first", "last", kind.alias("kind")).where("kind NOT IN ('body', 'figure_text')")


@query()
def page_segments(spark, d):
    return _read_segments(spark, d)[0].select("doc_id", "seg_order", "kind", "text", "page", "loc")


@query()
def page_segment_traces(spark, d):
    seg, lines = _read_segments(spark, d)
    return G.with_traces(seg, lines).select("doc_id", "seg_order", "kind", F.to_json("traces").alias("traces"))


@query()
def page_source_text(spark, d):
    return G.source_text(*_read_segments(spark, d))


@query()
def page_document_status(spark, d):
    return A.assess(_read_segments(spark, d)[0], N.failed_pages(_pages(spark, d)))


@query("SELECT DISTINCT doc_id, CAST(seg_order AS INT) AS seg_order, CAST(regexp_extract(loc, '^p(\\d+):L(\\d+)-(\\d+)$', 1) AS INT) AS page, CAST(regexp_extract(loc, '^p(\\d+):L(\\d+)-(\\d+)$', 2) AS INT) AS first, CAST(regexp_extract(loc, '^p(\\d+):L(\\d+)-(\\d+)$', 3) AS INT) AS last FROM segments WHERE regexp_matches(loc, '^p(\\d+):L(\\d+)-(\\d+)$')")
def parsed_locations(spark, d):
    s = table(spark, d, "segments").select("doc_id", "seg_order", X.pdf_loc(F.col("loc")).alias("at")).where("at IS NOT NULL")
    return s.select("doc_id", "seg_order", "at.page", "at.first", "at.last").distinct()


# ---- labels

_VERDICTS = "list_value({}) AS x"


def _verdict_sql(stage: str) -> str:
    ruling = "('A', 'D')" if stage != "machine_translation" else "('A')"
    acts = "[" + ", ".join(f"'{a}'" for a in P.STAGES[stage]) + "]"
    return f"CASE WHEN list_has_any(list_filter(coalesce(acts, []), lambda a: a IS NOT NULL), {acts}) THEN 'yes' WHEN list_contains(coalesce(acts, []), 'unknown') THEN 'unknown' WHEN coalesce(truth_basis IN {ruling}, false) AND (rest_basis IS NULL OR rest_basis = '' OR rest_basis IN {ruling}) THEN 'no' ELSE 'unknown' END"


@query("SELECT DISTINCT doc_id, bundle_id, " + ", ".join(f"{_verdict_sql(s)} AS {s}" for s in P.STAGES) + " FROM label_records")
def label_stages(spark, d):
    return table(spark, d, "label_records").select("doc_id", "bundle_id", *[L.stage_verdict(s).alias(s) for s in P.STAGES]).distinct()


@query("SELECT stage, verdict, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{s}' AS stage, {_verdict_sql(s)} AS verdict FROM label_records" for s in P.STAGES) + ") GROUP BY 1, 2")
def label_tally(spark, d):
    return L.tally(table(spark, d, "label_records"))


_DERIVED = "MAP {" + ", ".join(f"'{s}': {_verdict_sql(s)}" for s in P.STAGES) + "}"


@query(
    f"""WITH r AS (SELECT *, {_verdict_sql('body')} AS body, {_DERIVED} AS derived FROM label_records),
e AS (
  SELECT doc_id, 1 AS rule_no, '' AS item FROM r WHERE coalesce(trim(doc_id), '') = ''
  UNION ALL SELECT doc_id, 2, '' FROM r WHERE coalesce({_strip('bundle_id')}, '') = ''
  UNION ALL SELECT doc_id, 3, '' FROM r WHERE len(list_distinct(acts)) <> len(acts)
  UNION ALL SELECT doc_id, 4, '' FROM r WHERE truth_basis = 'D' AND len(list_filter(acts, lambda a: a <> 'machine_translation')) > 0
  UNION ALL SELECT doc_id, 5, coalesce(s.loc, '') FROM (SELECT doc_id, acts, unnest(spans) AS s FROM r) WHERE NOT coalesce(list_contains(acts, s.act), false)
  UNION ALL SELECT doc_id, 6, coalesce(s.loc, '') FROM (SELECT doc_id, unnest(spans) AS s FROM r) WHERE coalesce(trim(s.loc), '') = ''
  UNION ALL SELECT doc_id, 7, coalesce(s.loc, '') FROM (SELECT doc_id, unnest(spans) AS s FROM r) WHERE coalesce(s.lang NOT IN ('en', 'ko'), true)
  UNION ALL SELECT doc_id, 8, '' FROM r WHERE target_present <> '' AND target_present <> body
  UNION ALL SELECT doc_id, 9, e.key FROM (SELECT doc_id, derived, unnest(map_entries(stages)) AS e FROM r) WHERE e.value IS DISTINCT FROM derived[e.key]
  UNION ALL SELECT doc_id, 10, '' FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id) AS n FROM r WHERE doc_id IS NOT NULL) WHERE n > 1
  UNION ALL SELECT doc_id, 11, '' FROM r WHERE coalesce(truth_basis NOT IN ('A', 'B', 'C', 'D'), true)
  UNION ALL SELECT doc_id, 12, '' FROM r WHERE len(list_filter(acts, lambda a: a NOT IN ({', '.join(f"'{a}'" for a in P.ACTS)}))) > 0)
SELECT doc_id, rule_no, item, count(*) AS n FROM e GROUP BY 1, 2, 3"""
)
def label_errors(spark, d):
    return L.label_errors(_labels(spark, d)).groupBy("doc_id", "rule_no", "item").agg(F.count(F.lit(1)).alias("n"))


# ---- manifest


@query(
    """WITH e AS (
  SELECT doc_id, 1 AS rule_no FROM manifest WHERE coalesce(doc_id, '') = '' OR coalesce(bundle_id, '') = ''
  UNION ALL SELECT doc_id, 2 FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id) AS n FROM manifest WHERE doc_id IS NOT NULL) WHERE n > 1
  UNION ALL SELECT doc_id, 3 FROM manifest WHERE coalesce(role NOT IN ('seed', 'variant', 'analysis'), true)
  UNION ALL SELECT doc_id, 4 FROM manifest m WHERE role = 'variant' AND NOT EXISTS (SELECT 1 FROM manifest s WHERE s.role = 'seed' AND s.bundle_id = m.bundle_id))
SELECT doc_id, rule_no, count(*) AS n FROM e GROUP BY 1, 2"""
)
def manifest_errors(spark, d):
    m = table(spark, d, "manifest").withColumn("line_no", F.concat_ws("|", "doc_id", "retrieved_at"))
    return M.manifest_errors(m).groupBy("doc_id", "rule_no").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT 'journal' AS dimension, journal AS value, count(*) AS n FROM manifest GROUP BY 2
UNION ALL SELECT 'pub_year', CAST(pub_year AS VARCHAR), count(*) FROM manifest GROUP BY 2
UNION ALL SELECT 'subfield', value, count(*) FROM (SELECT unnest(subfields) AS value FROM manifest) GROUP BY 2"""
)
def manifest_counts(spark, d):
    return M.manifest_counts(table(spark, d, "manifest"))


_FIELDS_SQL = ", ".join("CASE WHEN regexp_matches(t, '\\b(" + "|".join(ks) + ")') THEN '" + k + "' END" for k, ks in P.SUBFIELDS.items())


@query(f"SELECT DISTINCT seed_id, array_to_string(list_filter([{_FIELDS_SQL}], lambda x: x IS NOT NULL), ',') AS subfields FROM (SELECT seed_id, lower(concat_ws(' ', title, abstract)) AS t FROM targets)")
def assigned_subfields(spark, d):
    return table(spark, d, "targets").select("seed_id", F.array_join(X.subfields(F.col("title"), F.col("abstract")), ",").alias("subfields")).distinct()


# ---- sampling

_STRATA = "WITH one AS (SELECT DISTINCT doc_id, journal, pub_year FROM manifest WHERE role = 'seed' AND journal IS NOT NULL AND pub_year IS NOT NULL AND doc_id IS NOT NULL), st AS (SELECT journal, pub_year, count(*) AS size FROM one GROUP BY 1, 2)"
_DRAW_N = 200
_QUOTA = f""", x AS (SELECT *, least({_DRAW_N}, sum(size) OVER ()) AS n, least({_DRAW_N}, sum(size) OVER ()) * size / CAST(sum(size) OVER () AS DOUBLE) AS exact FROM st),
y AS (SELECT *, least(floor(exact), size) AS base FROM x),
q AS (SELECT journal, pub_year, size, CAST(base + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, journal || '|' || pub_year) <= n - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM y)"""


def _seeds(spark, d):
    return table(spark, d, "manifest").where("role = 'seed' AND journal IS NOT NULL AND pub_year IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "journal", "pub_year").distinct()


@query(_STRATA + _QUOTA + " SELECT journal, pub_year, CAST(size AS BIGINT) AS size, quota FROM q")
def stratum_quotas(spark, d):
    sizes = _seeds(spark, d).groupBy("journal", "pub_year").agg(F.count(F.lit(1)).alias("size"))
    return S.allocate(sizes.withColumn("name", F.concat_ws("|", "journal", "pub_year")), _DRAW_N, "name").select("journal", "pub_year", "size", "quota")


@query(_STRATA + f" SELECT doc_id, journal, pub_year, CAST(row_number() OVER (PARTITION BY journal, pub_year ORDER BY sha256('{SEED}:' || doc_id), doc_id) AS INT) AS place FROM one")
def stratum_queues(spark, d):
    return S.queues(_seeds(spark, d), ["journal", "pub_year"], "doc_id", SEED)


@query(_STRATA + _QUOTA + ", pl AS (SELECT doc_id, journal, pub_year, row_number() OVER (PARTITION BY journal, pub_year ORDER BY sha256('" + str(SEED) + ":' || doc_id), doc_id) AS place FROM one) SELECT doc_id, journal, pub_year FROM pl JOIN q USING (journal, pub_year) WHERE place <= quota")
def quota_sample(spark, d):
    q = stratum_quotas(spark, d).select("journal", "pub_year", "quota")
    return stratum_queues(spark, d).join(q, ["journal", "pub_year"]).where("place <= quota").select("doc_id", "journal", "pub_year")


@query()
def proportional_sample(spark, d):
    return S.draw(_seeds(spark, d), ["journal", "pub_year"], "doc_id", _DRAW_N, SEED)


@query("SELECT o_orderkey, o_custkey, spent FROM (SELECT *, max(CASE WHEN spent > 500000 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS broken FROM (SELECT o_orderkey, o_custkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent FROM orders)) WHERE broken = 0")
def running_stop(spark, d):
    return S.running_stop(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", "o_totalprice", 500000.0, "o_custkey").select("o_orderkey", "o_custkey", "spent")


# ---- variants

_LATEST = "lo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY variant_id ORDER BY CAST(replace(created_at, 'Z', '+00:00') AS TIMESTAMPTZ) DESC, created_at DESC) AS rn FROM outputs_openai) WHERE rn = 1), ta AS (SELECT DISTINCT * FROM tasks)"


@query("WITH " + _LATEST + " SELECT variant_id, act, model_family FROM ta WHERE variant_id NOT IN (SELECT variant_id FROM outputs_openai)")
def remaining_tasks(spark, d):
    return V.remaining(_tasks(spark, d).select("variant_id", "act", "model_family"), table(spark, d, "outputs_openai"))


_PARTS = r"list_filter(list_transform(string_split(regexp_replace(" + _strip("step_outputs[-1]") + r", '\n\s*\n', chr(1), 'g'), chr(1)), lambda p: " + _strip(f"regexp_replace(p, '[{_SP}]+', ' ', 'g')") + r"), lambda p: p <> '')"


@query(
    "WITH " + _LATEST + f""", j AS (SELECT ta.variant_id, seed_id, act, kept_prefix, target_locs, step_outputs[-1] AS last_out, {_PARTS} AS parts FROM ta LEFT JOIN lo USING (variant_id))
SELECT variant_id, seed_id, act, CASE WHEN last_out IS NULL THEN 'no_output' WHEN len(parts) <> len(target_locs) OR (act = 'mixed' AND len(kept_prefix) <> len(target_locs)) THEN 'paragraph_count' ELSE 'ok' END AS status,
  CASE WHEN last_out IS NOT NULL AND len(parts) = len(target_locs) AND (act <> 'mixed' OR len(kept_prefix) = len(target_locs)) THEN array_to_string(CASE WHEN act = 'mixed' THEN list_transform(list_zip(kept_prefix, parts), lambda z: z[1] || ' ' || z[2]) ELSE parts END, chr(10)) END AS text FROM j"""
)
def built_variants(spark, d):
    return V.build(_tasks(spark, d), table(spark, d, "outputs_openai")).select("variant_id", "seed_id", "act", "status", F.array_join("paragraphs", "\n").alias("text"))


@query()
def changed_variants(spark, d):
    targets = table(spark, d, "targets").distinct()
    return V.check_changes(V.build(_tasks(spark, d), table(spark, d, "outputs_openai")), targets)


@query("SELECT act, model_family, count(*) AS tasks, CAST(sum(len(steps)) AS BIGINT) AS steps FROM (SELECT DISTINCT * FROM tasks) GROUP BY 1, 2")
def task_counts(spark, d):
    return _tasks(spark, d).groupBy("act", "model_family").agg(F.count(F.lit(1)).alias("tasks"), F.sum(F.size("steps")).alias("steps"))


@query("WITH " + _LATEST + " SELECT model, count(*) AS outputs, CAST(sum(usage.input_tokens) AS BIGINT) AS input_tokens, CAST(sum(usage.output_tokens) AS BIGINT) AS output_tokens FROM lo GROUP BY 1")
def output_usage(spark, d):
    o = V.latest(table(spark, d, "outputs_openai"))
    return o.groupBy("model").agg(F.count(F.lit(1)).alias("outputs"), F.sum("usage.input_tokens").alias("input_tokens"), F.sum("usage.output_tokens").alias("output_tokens"))


@query()
def planned_tasks(spark, d):
    return V.plan_tasks(table(spark, d, "targets").distinct(), ("alpha", "beta"), SEED)


_PATH = r"^(body\[1\]/sec\[\d+\])/(?:title|p)\[\d+\]$"


@query(
    f"""WITH {_ONE_SEGMENT}, t AS (SELECT doc_id, seg_order, m.kind AS kind, m.section AS section, m.loc AS loc, repeat(m.text || ' ', 4) AS text FROM seg),
s AS (SELECT *, CASE WHEN regexp_matches(loc, '^body\\[1\\]/') THEN regexp_extract(loc, '{_PATH}', 1) ELSE section END AS sec FROM t WHERE regexp_matches(section, '{P.INTRODUCTION}') AND kind IN ('body', 'heading')),
f AS (SELECT doc_id, arg_min(sec, seg_order) AS first_sec FROM s WHERE sec <> '' GROUP BY 1),
b AS (SELECT s.*, row_number() OVER (PARTITION BY doc_id ORDER BY seg_order) AS n FROM s JOIN f USING (doc_id) WHERE kind = 'body' AND sec = first_sec),
g AS (SELECT doc_id, count(*) AS k, bool_and({_WORDS} >= {P.TARGET_WORDS} AND NOT contains(text, '[FORMULA]')) AS good, string_agg(loc, ',' ORDER BY seg_order) AS locs FROM b WHERE n <= {P.TARGET_PARAGRAPHS} GROUP BY 1)
SELECT doc_id, coalesce(locs, '') AS locs FROM g WHERE k = {P.TARGET_PARAGRAPHS} AND good"""
)
def found_targets(spark, d):
    """Texts are taken four times over, as those of the tables are too short."""
    s = _segments(spark, d).withColumn("text", F.repeat(F.concat("text", F.lit(" ")), F.lit(4)))
    return V.find_targets(s).select("doc_id", F.array_join("locs", ",").alias("locs"))


_ABBR_SQL = "|".join(a.replace(".", r"\.") for a in P.ABBREVIATIONS)


@query(
    rf"""WITH p AS (SELECT seed_id, unnest(paragraphs) AS t, unnest(range(1, len(paragraphs) + 1)) AS n FROM (SELECT DISTINCT * FROM targets)),
m AS (SELECT seed_id, n, regexp_replace(regexp_replace({_strip('t')}, '([.!?])[{_SP}]+([A-Z\[(])', '\1' || chr(1) || '\2', 'g'), '(?i)\b((?:{_ABBR_SQL})\.)' || chr(1), '\1 ', 'g') AS t FROM p)
SELECT seed_id, CAST(n AS INT) AS n, CAST(len(string_split(t, chr(1))) AS INT) AS sentences FROM m WHERE t <> ''"""
)
def sentence_counts(spark, d):
    p = table(spark, d, "targets").distinct().select("seed_id", F.posexplode("paragraphs").alias("n", "t"))
    return p.select("seed_id", (F.col("n") + 1).alias("n"), F.size(X.sentences(F.col("t"))).alias("sentences")).where("sentences > 0")


@query("SELECT seed_id, score FROM (SELECT seed_id, CAST(least(coalesce(len(regexp_extract_all(abstract, '[₀-₉]')), 0), 10) + list_sum(list_transform(paragraphs, lambda p: len(regexp_extract_all(p, '\\b(?:[A-Z][a-z]?\\d+)+(?:[A-Z][a-z]?\\d*)*\\b')))) AS BIGINT) AS score FROM (SELECT DISTINCT * FROM targets)) ORDER BY score DESC, seed_id LIMIT 25")
def top_targets(spark, d):
    score = F.least(X.count(F.col("abstract"), "[₀-₉]"), F.lit(10)) + F.aggregate(F.transform("paragraphs", lambda p: X.count(p, P.PLAIN_FORMULA)), F.lit(0).cast("long"), lambda a, x: a + x)
    return table(spark, d, "targets").distinct().select("seed_id", score.alias("score")).orderBy(F.desc("score"), "seed_id").limit(25)


@query("SELECT DISTINCT doc_id FROM manifest WHERE role = 'seed' AND license = 'cc by' AND source = 'europepmc' AND NOT regexp_matches(title, '(?i)^\\s*(expression of concern|retraction|retracted|correction|corrigendum|erratum|withdrawn)')")
def seed_candidates(spark, d):
    return table(spark, d, "manifest").where("role = 'seed' AND license = 'cc by' AND source = 'europepmc'").where(~F.col("title").rlike(P.NOTICE)).select("doc_id").distinct()


@query("WITH " + _LATEST + r""", o AS (SELECT variant_id, unnest(step_outputs) AS text, unnest(range(1, len(step_outputs) + 1)) AS n FROM lo)
SELECT act, model_family, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[⁰-₟²³¹]'))) AS BIGINT) AS raised, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '\*\*'))) AS BIGINT) AS bold, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '\b(?:[A-Z][a-z]?\d+)+(?:[A-Z][a-z]?\d*)*\b'))) AS BIGINT) AS formulas
FROM o JOIN ta USING (variant_id) WHERE n = len(steps) GROUP BY 1, 2""")
def notation_probe(spark, d):
    o = V.latest(table(spark, d, "outputs_openai")).select("variant_id", F.posexplode("step_outputs").alias("n", "text"))
    j = o.join(_tasks(spark, d), "variant_id").where(F.col("n") + 1 == F.size("steps"))
    t = F.col("text")
    return j.groupBy("act", "model_family").agg(F.sum(X.count(t, P.TRACES["unicode_subsup"])).alias("raised"), F.sum(X.count(t, r"\*\*")).alias("bold"), F.sum(X.count(t, P.PLAIN_FORMULA)).alias("formulas"))


# ---- documents, files, XML


@query("WITH " + _ONE_SEGMENT + " SELECT doc_id, string_agg(m.text, chr(10) || chr(10) ORDER BY seg_order) AS text FROM seg WHERE m.kind = 'body' AND m.text IS NOT NULL GROUP BY doc_id")
def body_text(spark, d):
    return C.document_text(_segments(spark, d))


@query()
def extraction_agreement(spark, d):
    """The segments of each document against the text of its own documents rows, joined by paper."""
    seg = _segments(spark, d)
    truth = C.document_text(seg).withColumnRenamed("text", "body").join(C.document_text(seg, "reference").withColumnRenamed("text", "reference"), "doc_id", "left")
    # The longest text of a paper stands for its other extraction.
    other = table(spark, d, "documents").where("paper_id IS NOT NULL AND text IS NOT NULL").groupBy(F.col("paper_id").alias("doc_id")).agg(F.max_by("text", F.struct(F.length("text"), F.col("doc_id"))).alias("body"))
    return C.compare(truth, other.withColumn("reference", F.lit(None).cast("string")))


@query("SELECT DISTINCT path, CASE WHEN lower(path) LIKE '%.xml' THEN 'jats' WHEN lower(path) LIKE '%.pdf' THEN 'pages' ELSE 'none' END AS reader FROM manifest")
def file_readers(spark, d):
    f = table(spark, d, "manifest").select("path", F.lit(b"").alias("content")).distinct()
    return files.dispatch(f).select("path", "reader").distinct()


def _articles(spark, d):
    """Articles in XML made of the targets."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    t = table(spark, d, "targets").distinct()
    ps = F.array_join(F.transform("paragraphs", lambda p: F.concat(F.lit("<p>"), esc(p), F.lit("</p>"))), "")
    xml = F.concat(F.lit("<article><front><abstract><p>"), esc(F.coalesce("abstract", F.lit(""))), F.lit("</p></abstract></front><body><sec><title>1. Introduction</title>"), ps, F.lit("</sec></body></article>"))
    return t.select(F.col("seed_id").alias("doc_id"), xml.alias("content"), "paragraphs", "locs")


_CLEAN = _strip(f"regexp_replace(t, '[{_SP}]+', ' ', 'g')")


@query(
    f"""WITH a AS (SELECT DISTINCT * FROM targets),
p AS (SELECT seed_id AS doc_id, 'body' AS kind, abstract AS t, 'front[1]/abstract[1]/p[1]' AS loc FROM a
  UNION ALL SELECT seed_id, 'heading', '1. Introduction', 'body[1]/sec[1]/title[1]' FROM a
  UNION ALL SELECT seed_id, 'body', unnest(paragraphs), 'body[1]/sec[1]/p[' || unnest(range(1, len(paragraphs) + 1)) || ']' FROM a)
SELECT doc_id, kind, {_CLEAN} AS text, loc FROM p WHERE coalesce({_CLEAN}, '') <> ''"""
)
def jats_segments(spark, d):
    seg, _ = jats.read_jats(_articles(spark, d).select("doc_id", "content"))
    return seg.select("doc_id", "kind", "text", "loc")


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND NOT starts_with(text, '<')")
def broken_xml(spark, d):
    _, bad = jats.read_jats(table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.col("text").alias("content")))
    return bad.select(F.col("doc_id").cast("long").alias("doc_id"))


def _rich_articles(spark, d):
    """Articles with everything that an article may hold, made of the targets; ``{t}`` stands for the title."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    xml = (
        "<article><front><abstract abstract-type='graphical'><p>left out</p></abstract><abstract><p>{t} in brief</p>{subs}</abstract></front><body><sec><title>1. Introduction</title>"
        "<p>{t} with <inline-formula>k</inline-formula> and<table-wrap><p>inner {t}</p></table-wrap> after</p><list><list-item>first {t}</list-item><list-item>second {t}</list-item></list>"
        "<disp-formula>x</disp-formula><table-wrap><p>table {t}</p></table-wrap><fig><p>figure {t}</p></fig><boxed-text><p>left out</p></boxed-text>"
        "<sec><title>1.1. Scope</title><p>scope {t}</p></sec><sec sec-type='ack'><p>thanks {t}</p></sec></sec>"
        "<sec><title>Acknowledgements</title><p>thanks again {t}</p><p>holds<list><list-item>item {t}</list-item></list></p><sec><title>More</title><p>more {t}</p></sec></sec></body>"
        "<back><ack><p>left out</p></ack><ref-list><ref>one {t}</ref><ref>two {t}</ref></ref-list></back></article>"
    )
    t = table(spark, d, "targets").select("seed_id", "title").distinct()
    subs = F.repeat(F.lit("<sub>2</sub>"), F.length("title") % 4)
    return t.select(F.col("seed_id").alias("doc_id"), F.replace(F.replace(F.lit(xml), F.lit("{subs}"), subs), F.lit("{t}"), esc(F.coalesce("title", F.lit("")))).alias("content"))


_RICH = [
    ("body", "{t} in brief", "Abstract", "front[1]/abstract[2]/p[1]"), ("heading", "1. Introduction", "1. Introduction", "body[1]/sec[1]/title[1]"), ("body", "{t} with [FORMULA] and after", "1. Introduction", "body[1]/sec[1]/p[1]"), ("table", "inner {t}", "1. Introduction", "body[1]/sec[1]/p[1]/table-wrap[1]"),
    ("body", "first {t}", "1. Introduction", "body[1]/sec[1]/list[1]/list-item[1]"), ("body", "second {t}", "1. Introduction", "body[1]/sec[1]/list[1]/list-item[2]"), ("formula", "[FORMULA]", "1. Introduction", "body[1]/sec[1]/disp-formula[1]"), ("table", "table {t}", "1. Introduction", "body[1]/sec[1]/table-wrap[1]"),
    ("caption", "figure {t}", "1. Introduction", "body[1]/sec[1]/fig[1]"), ("heading", "1.1. Scope", "1.1. Scope", "body[1]/sec[1]/sec[1]/title[1]"), ("body", "scope {t}", "1.1. Scope", "body[1]/sec[1]/sec[1]/p[1]"), ("back_matter", "thanks {t}", "1. Introduction", "body[1]/sec[1]/sec[2]/p[1]"),
    ("heading", "Acknowledgements", "Acknowledgements", "body[1]/sec[2]/title[1]"), ("back_matter", "thanks again {t}", "Acknowledgements", "body[1]/sec[2]/p[1]"), ("back_matter", "holds", "Acknowledgements", "body[1]/sec[2]/p[2]"), ("body", "item {t}", "Acknowledgements", "body[1]/sec[2]/p[2]/list[1]/list-item[1]"),
    ("heading", "More", "More", "body[1]/sec[2]/sec[1]/title[1]"), ("back_matter", "more {t}", "More", "body[1]/sec[2]/sec[1]/p[1]"), ("reference", "one {t}", "References", "back[1]/ref-list[1]/ref[1]"), ("reference", "two {t}", "References", "back[1]/ref-list[1]/ref[2]"),
]
_RICH_ROWS = ", ".join(f"({i}, '{k}', '{t}', '{sec}', '{loc}')" for i, (k, t, sec, loc) in enumerate(_RICH))


@query(
    f"WITH a AS (SELECT DISTINCT seed_id, coalesce(title, '') AS title FROM targets), r AS (SELECT * FROM (VALUES {_RICH_ROWS}) AS v(seg_order, kind, t, section, loc)) "
    f"SELECT seed_id AS doc_id, CAST(seg_order AS INT) AS seg_order, kind, {_strip(f"regexp_replace(replace(t, '{{t}}', title), '[{_SP}]+', ' ', 'g')")} AS text, section, loc FROM a CROSS JOIN r"
)
def jats_structure(spark, d):
    seg, _ = jats.read_jats(_rich_articles(spark, d))
    return seg.select("doc_id", "seg_order", "kind", "text", "section", "loc")


@query("SELECT DISTINCT seed_id AS doc_id, CAST(length(title) % 4 AS INT) AS subscripts FROM targets")
def abstract_subscripts(spark, d):
    return jats.abstract_subscripts(_rich_articles(spark, d))


@query(f"WITH a AS (SELECT DISTINCT * FROM targets), p AS (SELECT seed_id AS doc_id, unnest(range(1, len(paragraphs) + 1)) AS n, upper(unnest(paragraphs)) AS t FROM a) SELECT doc_id, CAST(n AS INT) AS n, {_CLEAN} AS text FROM p WHERE coalesce({_CLEAN}, '') <> ''")
def spliced_articles(spark, d):
    a = _articles(spark, d)
    locs = F.transform(F.sequence(F.lit(1), F.size("paragraphs")), lambda i: F.concat(F.lit("body[1]/sec[1]/p["), i.cast("string"), F.lit("]")))
    new = a.select("doc_id", splice_paragraphs(F.col("content"), locs, F.transform("paragraphs", F.upper)).alias("content"))
    seg, _ = jats.read_jats(new)
    n = F.regexp_extract("loc", r"^body\[1\]/sec\[1\]/p\[(\d+)\]$", 1)
    return seg.where(n != "").select("doc_id", n.cast("int").alias("n"), "text")


_ENTRY = T.StructType([T.StructField(n, T.StringType()) for n in ("doc_id", "bundle_id", "source", "license")] + [T.StructField("pub_year", T.IntegerType())] + [T.StructField(n, T.StringType()) for n in ("journal", "path", "sha256")] + [T.StructField("subfields", T.ArrayType(T.StringType()))])


@query("SELECT doc_id, bundle_id, pub_year, journal, CASE WHEN subfields IS NOT NULL THEN coalesce(array_to_string(subfields, ','), '') END AS subfields FROM manifest")
def json_round_trip(spark, d):
    names = [f.name for f in _ENTRY]
    lines = files.to_json_lines(table(spark, d, "manifest"), names).select(F.lit("manifest").alias("file"), F.lit(0).alias("line_no"), "value")
    ok, _ = files.parse_lines(lines, _ENTRY, names[:8])
    return ok.select("doc_id", "bundle_id", "pub_year", "journal", F.array_join("subfields", ",").alias("subfields"))


_SPOILT = "CASE event_id % 5 WHEN 0 THEN props || '}' WHEN 1 THEN '[' || props || ']' WHEN 2 THEN '{\"z\": 1}' ELSE props END"


@query(f"WITH s AS (SELECT event_id, {_SPOILT} AS props FROM events) SELECT event_id, CASE WHEN NOT json_valid(props) THEN 'not_json' WHEN json_type(props) <> 'OBJECT' THEN 'not_an_object' ELSE 'unknown_key' END AS code FROM s WHERE props IS NOT NULL AND trim(props) <> '' AND (NOT json_valid(props) OR json_type(props) <> 'OBJECT' OR len(list_filter(json_keys(props), lambda k: k <> 'k')) > 0)")
def json_errors(spark, d):
    e = table(spark, d, "events").select("event_id", F.expr(_SPOILT).alias("props")).where("props IS NOT NULL").select(F.col("event_id").alias("line_no"), F.lit("events").alias("file"), F.col("props").alias("value"))
    _, bad = files.parse_lines(e, T.StructType([T.StructField("k", T.StringType())]), [])
    return bad.select(F.col("line_no").alias("event_id"), "code")


@query("SELECT count(*) AS records, CAST(coalesce((SELECT sum(n) FROM (" + SQL["label_errors"] + ")), 0) AS BIGINT) AS errors, coalesce((SELECT sum(n) FROM (" + SQL["label_errors"] + ")), 0) = 0 AS ok FROM label_records")
def labels_ok(spark, d):
    r = _labels(spark, d)
    n = L.label_errors(r).agg(F.count(F.lit(1)).alias("errors"))
    return r.agg(F.count(F.lit(1)).alias("records")).join(n, F.lit(True)).withColumn("ok", F.col("errors") == 0)  # one row each


#: Prices per million tokens of the cost estimate.
PRICES = (1.25, 10.0)


@query("WITH " + _LATEST + f" SELECT model, round(sum(cost_usd), 4) AS spent, round(sum((usage.input_tokens * {PRICES[0]} + usage.output_tokens * {PRICES[1]}) / 1000000.0), 4) AS estimated FROM lo GROUP BY 1")
def output_costs(spark, d):
    o = V.latest(table(spark, d, "outputs_openai"))
    return o.groupBy("model").agg(F.round(F.sum("cost_usd"), 4).alias("spent"), F.round(F.sum(V.estimated_cost(F.col("usage"), *PRICES)), 4).alias("estimated"))


_WORDS_WANTED = ("reactor", "membrane", "flow", "adsorption")


@query("SELECT DISTINCT doc_id FROM manifest WHERE pub_year BETWEEN 2015 AND 2021 AND license = 'cc by' AND coalesce(pmcid, '') <> '' AND (" + " OR ".join(f"contains(lower(title), '{w}')" for w in _WORDS_WANTED) + ")")
def remote_candidates(spark, d):
    return M.candidates(table(spark, d, "manifest"), 2015, 2021, _WORDS_WANTED).select("doc_id").distinct()
