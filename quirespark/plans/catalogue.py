"""The registry of queries over the driver's tables, each with its DuckDB oracle where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirespark.functions import binary, names, text
from quirespark.operators import ink, layout, relational
from quirespark.plans import convert

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The page format's white space in DuckDB's regular expressions.
WS = r"\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


#: Line numbers repeat within an order, so lines are numbered anew by a total order before anything depends on theirs.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
LINES_SQL = f"(SELECT * EXCLUDE l_linenumber, (row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}))::INT AS l_linenumber FROM lineitem)"


def sanitized_sql(value: str) -> str:
    """DuckDB's form of text.sanitize_name, but for what is not ASCII."""
    rules = [("[/\\\\]", "-"), ('[?<>:*|"\\x00-\\x1F]', ""), ("^\\.+$", ""), ("[. ]+$", ""), ("(?i)^(con|prn|aux|nul|com[0-9]|lpt[0-9])(\\..*)?$", ""), ("[\\[\\]#|^]", ""), (f"^[.{WS}]+", "")]
    for rule, to in rules:
        value = f"regexp_replace({value}, '{rule}', '{to}', 'g')"
    return f"coalesce(nullif(trim({value}), ''), 'Untitled')"


def query(sql: str | None = None):
    """Registers a function (tables: name -> DataFrame) under its name, with its oracle."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            def table(name: str) -> DataFrame:
                rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
                if name != "lineitem":
                    return rows
                return rows.withColumn("l_linenumber", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)))

            return f(table)

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = re.sub(r"\blineitem\b", LINES_SQL, sql)
        return f

    return register


FIRST_LINE = r"regexp_extract(text, '^[^\n]*')"


@query(
    rf"""
WITH l AS (SELECT doc_id, source, list_transform(string_split(text, chr(10)), lambda x: CASE
    WHEN regexp_matches(x, '^([{WS}]*)(#{{1,6}}|[-*+]|[0-9]+[.)])([{WS}])') THEN regexp_replace(x, '^([{WS}]*)(#{{1,6}}|[-*+]|[0-9]+[.)])([{WS}])', '\1\\\2\3')
    ELSE regexp_replace(x, '^([{WS}]*)(#{{1,6}}$|>|\||`{{3,}}|~{{3,}}|-{{3,}}$|={{3,}}$)', '\1\\\2') END) AS lines,
  {FIRST_LINE} AS head FROM documents),
t AS (SELECT doc_id, array_to_string(lines, chr(10)) AS body, {sanitized_sql('head')} AS title FROM l)
SELECT doc_id, title, sha256(body) AS digest, strlen(body) AS n_bytes FROM t
"""
)
def rendered_notes(t):
    """Bodies of documents as escaped notes, and their whole first lines as titles without what names reserve. Titles become
    paths, cut to the bytes a name may have, in titled_notes."""
    docs = t("documents").select("doc_id", text.escape_lines(F.col("text")).alias("body"), F.regexp_extract("text", r"\A[^\n]*", 0).alias("head"))
    return docs.select("doc_id", text.sanitize_name(F.col("head")).alias("title"), F.sha2(F.col("body").cast("binary"), 256).alias("digest"), F.octet_length("body").cast("long").alias("n_bytes"))


@query()
def titled_notes(t):
    """Notes as of rendered_notes, but the whole first line is the title and no two notes of a section get one path, also
    where a title ends in a number. The name is cut by bytes in a Unicode form that SQL does not have: no oracle."""
    docs = t("documents").select("doc_id", "source", text.escape_lines(F.col("text")).alias("body"), F.regexp_extract("text", r"\A[^\n]*", 0).alias("head"))
    found = docs.select("doc_id", "source", F.concat(names.file_name_column(F.col("head")), F.lit(".md")).alias("name"), F.sha2(F.col("body").cast("binary"), 256).alias("digest"), F.octet_length("body").cast("long").alias("n_bytes"))
    return layout.claimed(found, "source", "name", "doc_id").select("doc_id", F.concat("source", F.lit("/"), "claimed").alias("path"), "digest", "n_bytes")


@query(r"""SELECT page_id, regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '(?i)\.one$', '') AS title,
  array_to_string(list_filter(list_slice(string_split(replace(url, '\', '/'), '/'), 1, -2), lambda p: p <> '' AND p <> '.'), '>') AS groups FROM pages""")
def scan_sections(t):
    return t("pages").select("page_id", text.entry_title(F.col("url")).alias("title"), F.array_join(text.entry_groups(F.col("url")), ">").alias("groups"))


@query("SELECT source, count(*) AS n, sum(strlen(text))::BIGINT AS n_bytes, max(strlen(text))::BIGINT AS largest FROM documents GROUP BY source")
def list_sizes(t):
    size = F.octet_length("text").cast("long")
    return t("documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("n_bytes"), F.max(size).alias("largest"))


@query(r"""SELECT conv_id, turn, regexp_replace(CASE conv_id % 4 WHEN 0 THEN '[a](b) ' WHEN 1 THEN '`x` <b> ' WHEN 2 THEN '\[' ELSE '' END || text, '[\[\]`<]', '\\\0', 'g') AS escaped FROM conversations""")
def escape_inline(t):
    mark = F.when(F.col("conv_id") % 4 == 0, "[a](b) ").when(F.col("conv_id") % 4 == 1, "`x` <b> ").when(F.col("conv_id") % 4 == 2, "\\[").otherwise("")
    return t("conversations").select("conv_id", "turn", text.escape_inline(F.concat(mark, F.col("text"))).alias("escaped"))


PREFIXES = ["# ", "#x ", "> ", "| ", "- ", "* ", "+ ", "12. ", "3) ", "```", "~~~~", "\t## ", " - ", "-x", "7.", "####### ", "﻿> ", ""]
_PREFIX_SQL = "[" + ", ".join("'" + p + "'" for p in PREFIXES) + "]"


@query(
    rf"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM s),
p AS (SELECT doc_id, pos, CASE WHEN pos % 7 = 0 THEN '---' WHEN pos % 7 = 1 THEN '======' ELSE ({_PREFIX_SQL})[((doc_id + pos) % {len(PREFIXES)}) + 1] || line END AS line FROM l)
SELECT doc_id, pos, CASE WHEN regexp_matches(line, '^([{WS}]*)(#{{1,6}}|[-*+]|[0-9]+[.)])([{WS}])') THEN regexp_replace(line, '^([{WS}]*)(#{{1,6}}|[-*+]|[0-9]+[.)])([{WS}])', '\1\\\2\3')
    ELSE regexp_replace(line, '^([{WS}]*)(#{{1,6}}$|>|\||`{{3,}}|~{{3,}}|-{{3,}}$|={{3,}}$)', '\1\\\2') END AS escaped FROM p
"""
)
def escape_line_start(t):
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    prefix = F.element_at(F.array(*map(F.lit, PREFIXES)), ((F.col("doc_id") + F.col("pos")) % len(PREFIXES)).cast("int") + 1)
    line = F.when(F.col("pos") % 7 == 0, "---").when(F.col("pos") % 7 == 1, "======").otherwise(F.concat(prefix, "line"))
    return lines.select("doc_id", F.col("pos").cast("long").alias("pos"), text.escape_line_start(line).alias("escaped"))


@query(rf"""WITH x AS (SELECT doc_id, chr(160) || replace(text, '. ', chr(13) || chr(10) || chr(13) || chr(13) || chr(10)) || ' ' || chr(10) AS v FROM documents)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(v, '\r\n?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[{WS}]+|[{WS}]+$', '', 'g') AS body FROM x""")
def collapse_body(t):
    value = F.concat(F.lit(" "), F.replace(F.col("text"), F.lit(". "), F.lit("\r\n\r\r\n")), F.lit(" \n"))
    return t("documents").select("doc_id", text.collapse_body(value).alias("body"))


@query(r"""SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 9 BETWEEN 1 AND 6 THEN repeat('#', (l_partkey % 9)::INT) || ' ' ELSE '' END AS heading,
  repeat(chr(9), l_linenumber % 4) || CASE WHEN l_suppkey % 2 = 0 THEN '1. ' ELSE '- ' END AS list,
  CASE WHEN l_linenumber % 3 = 0 THEN repeat(chr(9), l_linenumber % 4) || CASE WHEN l_returnflag = 'R' THEN '- [x] ' ELSE '- [ ] ' END END AS task FROM lineitem""")
def heading_list_task_prefix(t):
    level = (F.col("l_linenumber") % 4).cast("int")
    tags = F.when(F.col("l_linenumber") % 3 == 0, F.array(F.struct(F.lit(True).alias("checkable"), (F.col("l_returnflag") == "R").alias("completed")))).otherwise(F.array().cast("array<struct<checkable:boolean,completed:boolean>>"))
    style = F.concat(F.lit("H"), (F.col("l_partkey") % 9).cast("string"))
    return t("lineitem").select("l_orderkey", "l_linenumber", text.heading_prefix(style).alias("heading"), text.list_prefix(level, F.col("l_suppkey") % 2 == 0).alias("list"), text.task_prefix(tags, level).alias("task"))


_SHAPES = [13, 15, 17, 21, 111, 3, 28, 200, 94]


@query(
    rf"""
WITH x AS (SELECT l_orderkey, l_linenumber, ({_SHAPES})[(l_partkey % {len(_SHAPES)} + 1)::INT] AS shape, l_suppkey % 4 = 0 AS dropped FROM lineitem WHERE l_linenumber <= 9),
y AS (SELECT * FROM x WHERE NOT dropped AND shape IN (13, 15, 17, 21, 111))
SELECT o.l_orderkey, arg_min(CASE shape WHEN 13 THEN 'important' WHEN 15 THEN 'question' WHEN 17 THEN 'danger' WHEN 21 THEN 'tip' WHEN 111 THEN 'question' END, l_linenumber) AS callout
FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN y USING (l_orderkey) GROUP BY 1
"""
)
def callout_first(t):
    shape = F.element_at(F.array(*map(F.lit, _SHAPES)), (F.col("l_partkey") % len(_SHAPES)).cast("int") + 1)
    tag = F.struct("l_linenumber", shape.alias("shape"), text.checkable(shape).alias("checkable"), (F.col("l_suppkey") % 4 == 0).alias("dropped"))
    tags = t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(tag)).alias("tags"))
    return tags.select("l_orderkey", text.callout(F.filter(F.slice("tags", 1, 9), lambda x: ~x["dropped"])).alias("callout"))


@query("""
WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events),
i AS (SELECT user_id, event_type, g, min(event_id) AS first, count(*) AS n FROM x GROUP BY ALL)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY first) AS island, event_type, n FROM i""")
def callout_merge(t):
    return relational.islands(t("events"), ["user_id"], ["event_id"], "event_type")


_INKS_SQL = ", ".join(f"({k}, '{m}', {r}, {g}, {b})" for k, (m, r, g, b) in enumerate(text.INKS))


@query(
    f"""
WITH inks(k, m, r, g, b) AS (VALUES {_INKS_SQL}),
c AS (SELECT p_partkey, (p_partkey * 7919) % 16777216 AS v FROM part),
d AS (SELECT p_partkey, v, arg_min(m, ((r - v % 256) ** 2 + (g - v // 256 % 256) ** 2 + (b - v // 65536) ** 2)::BIGINT * 16 + k) AS marker FROM c, inks GROUP BY ALL)
SELECT p_partkey, '#' || lower(printf('%02x%02x%02x', v % 256, v // 256 % 256, v // 65536)) AS color, marker FROM d
"""
)
def highlight_nearest(t):
    color = text.color_text((F.col("p_partkey") * 7919) % 16777216)
    return t("part").select("p_partkey", color.alias("color")).withColumn("marker", text.highlight_marker(F.col("color")))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, [l_returnflag || '|' || l_linestatus, 'a  ' || l_linenumber, l_partkey::VARCHAR][1:1 + (l_partkey % 3)::INT] AS cells FROM lineitem),
w AS (SELECT l_orderkey, max(len(cells)) AS width FROM r GROUP BY 1),
x AS (SELECT l_orderkey, l_linenumber, width, '| ' || array_to_string(list_concat(list_transform(cells, lambda c: replace(regexp_replace(c, '\\s+', ' ', 'g'), '|', '\\|')), list_transform(range(width - len(cells)), lambda i: '')), ' | ') || ' |' AS line FROM r JOIN w USING (l_orderkey))
SELECT l_orderkey, arg_min(line, l_linenumber) || chr(10) || '| ' || array_to_string(list_transform(range(any_value(width)), lambda i: '---'), ' | ') || ' |' ||
  coalesce(chr(10) || string_agg(line, chr(10) ORDER BY l_linenumber) FILTER (WHERE l_linenumber > 1), '') AS markdown FROM x GROUP BY l_orderkey""".replace("\\\\", "\\"))
def table_gfm(t):
    cells = F.slice(F.array(F.concat("l_returnflag", F.lit("|"), "l_linestatus"), F.concat(F.lit("a  "), F.col("l_linenumber").cast("string")), F.col("l_partkey").cast("string")), F.lit(1), (F.col("l_partkey") % 3).cast("int") + 1)
    rows = t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", cells.alias("cells")))).alias("rows"))
    return rows.select("l_orderkey", text.gfm_table(F.transform("rows", lambda r: r["cells"])).alias("markdown"))


_TITLES = ["", ".", "..", "con", "LPT1.txt", "a/b\\c", "what? <x>", "[x]#|^", " .lead", "trail. . "]
_TITLES_SQL = "[" + ", ".join("'" + p + "'" for p in _TITLES) + "]"


@query(
    rf"""
WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN ({_TITLES_SQL})[(p_partkey % {len(_TITLES)} + 1)::INT] ELSE p_name || ({_TITLES_SQL})[(p_partkey % {len(_TITLES)} + 1)::INT] END AS v FROM part)
SELECT p_partkey, {sanitized_sql('v')} AS name FROM x
"""
)
def sanitize_title(t):
    extra = F.element_at(F.array(*map(F.lit, _TITLES)), (F.col("p_partkey") % len(_TITLES)).cast("int") + 1)
    return t("part").select("p_partkey", text.sanitize_name(F.when(F.col("p_partkey") % 3 == 0, extra).otherwise(F.concat("p_name", extra))).alias("name"))


@query("""
WITH x AS (SELECT p_partkey, p_brand, p_type || '.md' AS name, row_number() OVER (PARTITION BY p_brand, lower(p_type) ORDER BY p_partkey) - 1 AS k FROM part)
SELECT p_partkey, p_brand, name, CASE WHEN k = 0 THEN name ELSE left(name, len(name) - 3) || ' ' || k || '.md' END AS claimed FROM x""")
def claim_names(t):
    return layout.claimed(t("part").select("p_partkey", "p_brand", F.concat("p_type", F.lit(".md")).alias("name")), "p_brand", "name", "p_partkey")


_DEPTH_SQL = """
x AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderkey % 4 AS level FROM orders),
d AS (SELECT o_custkey, o_orderkey, i, (i + min(CASE WHEN i = 1 THEN 0 ELSE level END - i) OVER (PARTITION BY o_custkey ORDER BY i))::INT AS depth FROM x)"""


def _nested(t):
    return layout.with_depth(t("orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 4).alias("level")), ["o_custkey"], ["o_orderkey"], "level")


@query(f"WITH {_DEPTH_SQL} SELECT o_custkey, o_orderkey, depth FROM d")
def subpage_depth(t):
    return _nested(t).select("o_custkey", "o_orderkey", "depth")


@query(f"WITH {_DEPTH_SQL} SELECT a.o_custkey, a.o_orderkey, a.depth, max(b.o_orderkey) AS parent FROM d a LEFT JOIN d b ON a.o_custkey = b.o_custkey AND b.i < a.i AND b.depth = a.depth - 1 GROUP BY ALL")
def subpage_parent(t):
    return layout.with_parent(_nested(t), ["o_custkey"], "o_orderkey", "o_orderkey").select("o_custkey", "o_orderkey", "depth", "parent")


#: Names that end in numbers, so that some meet the numbered names of others.
_NUMBERED_SQL = "SELECT p_partkey, p_brand, CASE WHEN p_size % 3 = 0 THEN split_part(p_type, ' ', 1) WHEN p_size % 3 = 1 THEN lower(split_part(p_type, ' ', 1)) || ' ' || p_size % 7 ELSE split_part(p_type, ' ', 1) || ' 1 ' || p_size % 4 END || '.md' AS name FROM part"


@query(f"""
WITH RECURSIVE x AS ({_NUMBERED_SQL}),
y AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i, left(name, len(name) - 3) AS base FROM x),
c AS (SELECT p_partkey, p_brand, i, name AS claimed, [lower(name)] AS taken FROM y WHERE i = 1
  UNION ALL
  SELECT p_partkey, p_brand, i, free, list_append(taken, lower(free)) FROM (
    SELECT y.p_partkey, y.p_brand, y.i, c.taken, list_filter([name] || list_transform(range(1, y.i), lambda k: base || ' ' || k || '.md'), lambda n: NOT list_contains(c.taken, lower(n)))[1] AS free
    FROM c JOIN y ON y.p_brand = c.p_brand AND y.i = c.i + 1))
SELECT p_partkey, p_brand, claimed FROM c""")
def claim_numbered(t):
    """Names claimed in turn, where names that end in numbers compete for the numbers of others."""
    word, n = F.split_part("p_type", F.lit(" "), F.lit(1)), F.col("p_size")
    number = lambda k: (n % k).cast("string")
    name = F.when(n % 3 == 0, word).when(n % 3 == 1, F.concat(F.lower(word), F.lit(" "), number(7))).otherwise(F.concat(word, F.lit(" 1 "), number(4)))
    return layout.claimed(t("part").select("p_partkey", "p_brand", F.concat(name, F.lit(".md")).alias("name")), "p_brand", "name", "p_partkey").select("p_partkey", "p_brand", "claimed")


_PLACED_SQL = "SELECT *, folder || '/' || name AS own FROM (SELECT o_custkey, o_orderkey, folder, o_orderpriority || CASE WHEN k = 1 THEN '' ELSE ' ' || (k - 1) END AS name FROM (SELECT *, row_number() OVER (PARTITION BY folder, o_orderpriority ORDER BY o_custkey, o_orderkey) AS k FROM ({})))"


@query(f"""
WITH {_DEPTH_SQL},
p AS (SELECT d.*, o_orderpriority, (SELECT max(b.o_orderkey) FROM d b WHERE b.o_custkey = d.o_custkey AND b.i < d.i AND b.depth = d.depth - 1) AS parent FROM d JOIN orders USING (o_custkey, o_orderkey)),
l0 AS ({_PLACED_SQL.format("SELECT p.*, 'Customers ' || o_custkey % 10 AS folder FROM p WHERE depth = 0")}),
l1 AS ({_PLACED_SQL.format("SELECT p.*, own AS folder FROM p JOIN l0 ON p.parent = l0.o_orderkey WHERE depth = 1")}),
l2 AS ({_PLACED_SQL.format("SELECT p.*, own AS folder FROM p JOIN l1 ON p.parent = l1.o_orderkey WHERE depth = 2")}),
l3 AS ({_PLACED_SQL.format("SELECT p.*, own AS folder FROM p JOIN l2 ON p.parent = l2.o_orderkey WHERE depth = 3")})
SELECT o_orderkey, folder, name AS stem FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)""")
def nested_paths(t):
    """Folders and names of notes nested up to three levels, claimed level by level; sections share folders."""
    pages = t("orders").select(F.col("o_custkey").alias("section"), F.col("o_orderkey").alias("page_id"), F.col("o_orderkey").alias("page_ord"), (F.col("o_orderkey") % 4).alias("level"))
    names_of = t("orders").select(F.col("o_custkey").alias("section"), F.col("o_orderkey").alias("page_id"), F.col("o_orderpriority").alias("file_name"))
    pages = pages.join(names_of, ["section", "page_id"]).withColumn("section_folder", F.concat(F.lit("Customers "), (F.col("section") % 10).cast("string"))).withColumn("turn", F.struct("section", "page_ord"))
    return convert.placed_pages(pages, nest=True).select(F.col("page_id").alias("o_orderkey"), "folder", "stem")


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey % 60 AS boundary, 40 AS n FROM lineitem),
y AS (SELECT *, max(least(boundary, n)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS "end" FROM x)
SELECT l_orderkey, l_linenumber, coalesce(lag("end") OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 0) AS "first", "end" FROM y""")
def run_slices(t):
    runs = t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 60).alias("boundary"), F.lit(40).cast("long").alias("n"))
    return layout.run_slices(runs, ["l_orderkey"], "l_linenumber", "boundary", "n").select("l_orderkey", "l_linenumber", "first", "end")


@query("""
WITH x AS (SELECT user_id, event_id, CASE WHEN event_type = 'signup' OR event_id % 5 = 0 THEN 'u' || event_id END AS field, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'text' END AS body, CASE WHEN event_id % 11 = 0 THEN 'own' END AS url FROM events),
g AS (SELECT *, count(field) OVER w AS grp, last_value(field IGNORE NULLS) OVER w AS pending FROM x WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
n AS (SELECT *, sum((body <> '')::INT) OVER (PARTITION BY user_id, grp ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS nth FROM g)
SELECT user_id, event_id, coalesce(url, CASE WHEN body <> '' AND nth = 1 AND grp > 0 THEN pending END) AS link FROM n""")
def link_carry(t):
    field = F.when((F.col("event_type") == "signup") | (F.col("event_id") % 5 == 0), F.concat(F.lit("u"), F.col("event_id").cast("string")))
    runs = t("events").select("user_id", "event_id", field.alias("field"), F.when(F.col("event_id") % 3 == 0, "").otherwise("text").alias("body"), F.when(F.col("event_id") % 11 == 0, "own").alias("url"))
    return layout.carried_links(runs, ["user_id"], ["event_id"], "field", "body", "url").select("user_id", "event_id", "link")


@query("""
SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders
WHERE o_orderstatus <> 'P' AND o_orderkey % 3 <> 0 AND (CASE WHEN o_orderkey % 5 = 0 THEN 'c' END) IS NULL) WHERE k = 1 GROUP BY o_custkey""")
def revision_current(t):
    rows = t("orders").select("o_custkey", "o_orderkey", "o_orderdate", (F.col("o_orderstatus") == "P").alias("is_encrypted"), F.when(F.col("o_orderkey") % 3 == 0, 2).otherwise(1).alias("role"), F.when(F.col("o_orderkey") % 5 == 0, "c").alias("context_id"))
    return relational.current_revision(rows, ["o_custkey"], F.lit(None).cast("string"), ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("""
WITH RECURSIVE l AS (SELECT o_orderkey AS node, CASE WHEN o_orderkey % 6 <> 0 THEN lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS dep FROM orders),
r AS (SELECT node, node AS root, 0 AS depth FROM l WHERE dep IS NULL UNION ALL SELECT l.node, r.root, r.depth + 1 FROM l JOIN r ON l.dep = r.node)
SELECT node, root, depth FROM r""")
def revision_chain(t):
    dep = F.when(F.col("o_orderkey") % 6 != 0, F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    return relational.chain_depth(t("orders").select(F.col("o_orderkey").alias("node"), dep.alias("dep")), "node", "dep")


@query("SELECT space, l_partkey, l_orderkey, l_linenumber, l_quantity FROM (SELECT l_orderkey % 10 AS space, *, row_number() OVER (PARTITION BY l_orderkey % 10, l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC) AS k FROM lineitem) WHERE k = 1")
def space_replay(t):
    rows = t("lineitem").select((F.col("l_orderkey") % 10).alias("space"), "l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    return relational.last_of(rows, ["space", "l_partkey"], ["l_orderkey", "l_linenumber"])


@query("""SELECT l_orderkey, l_partkey % 5 AS object, arg_max(l_suppkey, l_linenumber) FILTER (WHERE l_linenumber % 3 = 1) AS data, arg_max(l_returnflag, l_linenumber) FILTER (WHERE l_linenumber % 3 = 2) AS file,
  max(l_quantity) AS ref_count, min(l_linenumber) AS first_seen FROM lineitem GROUP BY ALL""")
def partition_merge(t):
    part = lambda k, c: F.max_by(c, F.when(F.col("l_linenumber") % 3 == k, F.col("l_linenumber")))
    return t("lineitem").groupBy("l_orderkey", (F.col("l_partkey") % 5).alias("object")).agg(part(1, "l_suppkey").alias("data"), part(2, "l_returnflag").alias("file"), F.max("l_quantity").alias("ref_count"), F.min("l_linenumber").alias("first_seen"))


@query("SELECT c_custkey, n_name, r_name, min(s_suppkey) AS first_supplier, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def cell_chain(t):
    first = t("supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("first_supplier"), F.count(F.lit(1)).alias("n"))
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).join(first, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", "n_name", "r_name", "first_supplier", "n")


@query("SELECT o_orderkey, arg_min(p_name, l_linenumber) AS first_child, arg_max(p_name, l_linenumber) FILTER (WHERE p_size > 25) AS last_large FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey")
def ref_join_ordered(t):
    refs = t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber").join(t("part").select("p_partkey", "p_name", "p_size"), F.col("p_partkey") == F.col("l_partkey"), "left")
    by_order = refs.groupBy("l_orderkey").agg(F.min_by("p_name", "l_linenumber").alias("first_child"), F.max_by("p_name", F.when(F.col("p_size") > 25, F.col("l_linenumber"))).alias("last_large"))
    return t("orders").select("o_orderkey").join(by_order, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "first_child", "last_large")


@query("""
WITH x AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber) AS a, list(l_suppkey ORDER BY l_linenumber) FILTER (WHERE l_linenumber % 2 = 1) AS b FROM lineitem GROUP BY 1),
p AS (SELECT l_orderkey, a, b, unnest(range(greatest(len(a), len(b)))) AS pos FROM x)
SELECT l_orderkey, pos, a[pos + 1] AS object, b[pos + 1] AS identity FROM p""")
def compactid_zip(t):
    at = lambda c: F.transform(F.sort_array(F.collect_list(c)), lambda x: x["v"])
    rows = t("lineitem").groupBy("l_orderkey").agg(at(F.struct("l_linenumber", F.col("l_partkey").alias("v"))).alias("object"), at(F.when(F.col("l_linenumber") % 2 == 1, F.struct("l_linenumber", F.col("l_suppkey").alias("v")))).alias("identity"))
    return relational.zip_positions(rows, "object", "identity", ["l_orderkey"]).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT user_id, event_id, coalesce(last_value(CASE WHEN event_id % 4 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 'none') AS type FROM events")
def asof_type(t):
    rows = t("events").select("user_id", "event_id", F.when(F.col("event_id") % 4 == 0, F.col("event_type")).alias("known"))
    return rows.select("user_id", "event_id", relational.latest_known(rows, ["user_id"], ["event_id"], "known", "none").alias("type"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) WHERE k = 1")
def page_dedupe(t):
    return relational.last_of(t("events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"], descending=False)


@query("SELECT doc_id, source, sha256(text) AS digest, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) = 1 AS written FROM (SELECT doc_id, 'src' || doc_id % 2 AS source, text FROM documents)")
def asset_dedupe(t):
    docs = t("documents").select("doc_id", F.concat(F.lit("src"), (F.col("doc_id") % 2).cast("string")).alias("source"), "text")
    return layout.first_copies(docs, "source", F.col("text").cast("binary"), ["doc_id"]).select("doc_id", "source", "digest", "written")


_HEADS = ["89504E470D0A", "FFD8FFE0", "47494638", "25504446", "49492A00", "4D4D002A", "424D00", "1F8B08", "494433", "524946460000000057454250", "524946460000000057415645", "0000001866747970617669660000", "00000018667479706865696300", "0000001866747970717420200000", "000000186674797069736F6D", "504B0304", "D0CF11E0A1B11AE1", "4D534346", "", "52494646"]
_KINDS = ["png", "jpg", "gif", "pdf", "tiff", "tiff", "bmp", "gz", "mp3", "webp", "wav", "avif", "heic", "mov", "mp4", "zip", None, None, None, None]
_HEADS_SQL = ", ".join(f"({k}, {'NULL' if x is None else repr(x)}, '{'cabinet' if h.startswith('4D53') else 'compound' if h.startswith('D0CF') else 'section'}')" for k, (h, x) in enumerate(zip(_HEADS, _KINDS, strict=True)))


@query(f"WITH h(k, kind, container) AS (VALUES {_HEADS_SQL}) SELECT p_partkey, kind, container FROM part JOIN h ON p_partkey % {len(_HEADS)} = k")
def magic_sniff(t):
    data = F.concat(F.unhex(F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("p_partkey") % len(_HEADS)).cast("int") + 1)), F.unhex(F.lit("FF")))
    return t("part").select("p_partkey", binary.magic_kind(data).alias("kind"), binary.container_kind(data).alias("container"))


@query("""
WITH b AS (SELECT conv_id, turn, hex(encode(text)) AS h, strlen(text) // 4 AS n FROM conversations),
w AS (SELECT conv_id, turn, h, n, unnest(range(greatest(n, 1))) AS i FROM b),
x AS (SELECT conv_id, turn, any_value(h) AS h, any_value(n) AS n, bit_xor(CASE WHEN i < n THEN ('0x' || substr(h, 8 * i + 7, 2) || substr(h, 8 * i + 5, 2) || substr(h, 8 * i + 3, 2) || substr(h, 8 * i + 1, 2))::BIGINT ELSE 0 END) AS total FROM w GROUP BY conv_id, turn)
SELECT conv_id, turn, xor(total, CASE WHEN substr(h, 8 * n + 1) = '' THEN 0 ELSE ('0x' || substr(h, 8 * n + 1))::BIGINT END)::BIGINT AS checksum FROM x""")
def cab_checksum(t):
    return t("conversations").select("conv_id", "turn", binary.cabinet_checksum(F.col("text").cast("binary")).alias("checksum"))


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, sum(l_partkey % 101 - 50) OVER w::BIGINT AS x, sum(l_suppkey % 67 - 33) OVER w::BIGINT AS y FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING))
SELECT l_orderkey, min(x)::BIGINT AS min_x, min(y)::BIGINT AS min_y, max(x)::BIGINT AS max_x, max(y)::BIGINT AS max_y FROM p GROUP BY 1""".replace("OVER w::BIGINT", "OVER w"))
def ink_bounds(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 101 - 50).alias("dx"), (F.col("l_suppkey") % 67 - 33).alias("dy"))
    points = ink.absolute(ink.absolute(rows, ["l_orderkey"], "l_linenumber", "dx", "x"), ["l_orderkey"], "l_linenumber", "dy", "y")
    return ink.bounds(points, ["l_orderkey"])


@query()
def ink_drawings(t):
    points = t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").alias("x"), F.col("l_tax").alias("y")))).alias("points"))
    stroke = F.struct("points", F.lit("#000000").alias("color"), F.lit(1.0).alias("width"), F.lit(0.5).alias("opacity"))
    return points.select("l_orderkey", ink.drawing_column(F.array(stroke)).alias("svg"))


@query()
def name_functions(t):
    """Titles, link targets and formulas of part names with characters that have several forms."""
    value = F.concat("p_name", F.lit(" é/x²+y₁ ﬁ"))
    return t("part").select("p_partkey", names.file_name_column(value).alias("file_name"), names.uri_column(value).alias("uri"), names.latex_column(value).alias("latex"))


@query(r"""
SELECT d.doc_id, array_to_string(list_filter(['---', 'title: ' || to_json(regexp_extract(text, '^[^\n]*') || '"q\')::VARCHAR, 'source: onenote', 'onenote-id: ' || to_json(d.doc_id::VARCHAR)::VARCHAR, 'section: ' || to_json(source)::VARCHAR,
  CASE WHEN d.doc_id % 2 = 0 THEN 'notebook: "nb"' END, CASE WHEN d.doc_id % 3 = 0 THEN 'section-group: "a/b"' END, 'updated: 2024-01-02T03:04:05.678Z', CASE WHEN quality = 1 THEN 'conflict: true' END, CASE WHEN toxic = 1 THEN 'deleted: true' END, '---', ''], lambda x: x IS NOT NULL), chr(10)) AS header
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def front_matter(t):
    rows = t("documents").join(t("labels"), "doc_id", "left")
    groups = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    header = text.front_matter(F.concat(F.regexp_extract("text", r"\A[^\n]*", 0), F.lit('"q\\')), F.col("doc_id").cast("string"), F.col("source"), F.when(F.col("doc_id") % 2 == 0, "nb").otherwise(""), groups, F.lit("2024-01-02 03:04:05.678").cast("timestamp_ntz"), F.col("quality") == 1, F.col("toxic") == 1)
    return rows.select("doc_id", header.alias("header"))


_CODES = [*text.UNSUPPORTED, "ONENOTE_OFFSET_RANGE", "ONENOTE_CAB_ENTRY_LIMIT", "ONENOTE_ONEX_PROTECTED", "ONENOTE_CAB_CHECKSUM"]


@query(f"WITH x AS (SELECT event_id, ({_CODES})[(event_id % {len(_CODES)} + 1)::INT] AS code FROM events) SELECT code, CASE WHEN code LIKE '%\\_LIMIT' ESCAPE '\\' OR code = 'ONENOTE_OFFSET_RANGE' THEN 'limit' WHEN code = 'ONENOTE_ONEX_PROTECTED' THEN 'protected' WHEN code = 'ONENOTE_CAB_CHECKSUM' THEN 'malformed' ELSE 'unsupported' END AS kind, count(*) AS n FROM x GROUP BY ALL")
def error_kinds(t):
    code = F.element_at(F.array(*map(F.lit, _CODES)), (F.col("event_id") % len(_CODES)).cast("int") + 1)
    return t("events").select(code.alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).select("code", text.error_kind(F.col("code")).alias("kind"), "n")


@query("SELECT source AS input, count(*) FILTER (WHERE doc_id % 7 <> 0) AS notes, count(DISTINCT CASE WHEN doc_id % 3 = 0 THEN sha256(text) END) AS attachments, count(*) FILTER (WHERE doc_id % 7 = 0) AS errors FROM documents GROUP BY 1")
def report_by_input(t):
    docs = t("documents")
    digest = F.when(F.col("doc_id") % 3 == 0, F.sha2(F.col("text").cast("binary"), 256))
    return docs.groupBy(F.col("source").alias("input")).agg(F.count_if(F.col("doc_id") % 7 != 0).alias("notes"), F.count_distinct(digest).alias("attachments"), F.count_if(F.col("doc_id") % 7 == 0).alias("errors"))


@query("""
WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents), b AS (SELECT CASE WHEN doc_id % 3 = 0 THEN -doc_id - 1 ELSE doc_id END AS doc_id, sha256(CASE WHEN doc_id % 4 = 0 THEN text || '!' ELSE text END) AS h FROM documents)
SELECT doc_id, CASE WHEN b.h IS NULL THEN 'missing' WHEN a.h IS NULL THEN 'unexpected' ELSE 'differs' END AS kind FROM a FULL JOIN b USING (doc_id) WHERE a.h IS DISTINCT FROM b.h""")
def tree_diff(t):
    """All documents against the same tree with some ids renamed (a third) and some texts edited (a quarter)."""
    docs = t("documents")
    digest = lambda c: F.sha2(c.cast("binary"), 256).alias("h")
    renamed = F.when(F.col("doc_id") % 3 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    edited = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return relational.difference(docs.select("doc_id", digest(F.col("text"))), docs.select(renamed.alias("doc_id"), digest(edited)), ["doc_id"], "h")
