"""Registered queries: sampled curves, matching and text ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from curveloom.functions.scalars import (
    cosine_stations, file_stem, file_suffix, literal_array, midcell_stations,
)
from curveloom.operators import curves, matching
from curveloom.operators.quality import first_failures
from curveloom.plans.assembly import QUANTITIES, surface_profiles
from curveloom.registry.book import Book, r6, rounded
from curveloom.registry.views import (
    CURVE, LINES, TEXT, VEC, curve, dump_text, table, text, user_load, vec,
)
from curveloom.sources import records
from curveloom.sources.text import parse_dump, parse_pairs, parse_polar, point_rows, rejected

book = Book()
KEY = ["curve_id"]


def _curve(spark, folder):
    hot = user_load(spark, folder)
    return curve(spark, folder, hot), hot


@book.add("step_delta", f"""
WITH {CURVE} SELECT curve_id, ord, x, x - lag(x) OVER (PARTITION BY curve_id ORDER BY ord) AS delta FROM curve""")
def step_delta(spark, folder):
    rows, hot = _curve(spark, folder)
    return curves.step_delta(rows.select("curve_id", "ord", "x"), KEY, ["ord"], "x", hot=hot)


@book.add("drop_repeats", f"""
WITH {CURVE}, p AS (SELECT *, lag(event_type) OVER (PARTITION BY curve_id ORDER BY ord) AS before FROM curve)
SELECT curve_id, ord, event_type FROM p WHERE before IS NULL OR before <> event_type""")
def drop_repeats(spark, folder):
    rows, hot = _curve(spark, folder)
    return curves.drop_repeats(
        rows.select("curve_id", "ord", "event_type"), KEY, ["ord"], ["event_type"], hot
    )


@book.add("drop_near_duplicates", f"""
WITH {CURVE}, p AS (SELECT *, lag(x) OVER (PARTITION BY curve_id ORDER BY x, ord) AS before FROM curve)
SELECT curve_id, ord, x FROM p WHERE before IS NULL OR x - before > 0.005e0""")
def drop_near_duplicates(spark, folder):
    rows, hot = _curve(spark, folder)
    return curves.drop_near_duplicates(
        rows.select("curve_id", "ord", "x"), KEY, "x", "ord", 0.005, hot
    )


STEP_SIGN = f"""{CURVE}, d AS (
  SELECT *, lead(x) OVER (PARTITION BY curve_id ORDER BY ord) - x AS dx FROM curve),
turn AS (SELECT curve_id, max(CASE WHEN dx < 0 THEN ord END) AS down,
  min(CASE WHEN dx > 0 THEN ord END) AS up, max(ord) AS n FROM d GROUP BY curve_id),
good AS (SELECT * FROM turn WHERE down + 1 >= 5 AND n + 1 - up >= 5),
surfaces AS (
  SELECT curve_id, 'upper' AS surface, ord, x, y, down + 2 - ord AS place
  FROM curve JOIN good USING (curve_id) WHERE ord <= down + 1
  UNION ALL
  SELECT curve_id, 'lower', ord, x, y, ord - up + 1 FROM curve JOIN good USING (curve_id) WHERE ord >= up)"""


@book.add("split_by_step_sign", f"WITH {STEP_SIGN} SELECT curve_id, surface, ord, place FROM surfaces")
def split_by_step_sign(spark, folder):
    rows, hot = _curve(spark, folder)
    surfaces, _ = curves.split_by_step_sign(
        rows.select("curve_id", "ord", "x"), KEY, "x", "ord", hot=hot
    )
    return surfaces.select("curve_id", "surface", "ord", "place")


@book.add("split_rejects", f"""
WITH {STEP_SIGN} SELECT curve_id, CASE WHEN down IS NULL OR up IS NULL
  THEN 'the curve does not turn into two sides' ELSE 'one side of the curve has too few samples' END AS reason
FROM (SELECT curve_id, down, up, n FROM turn) t
WHERE down IS NULL OR up IS NULL OR down + 1 < 30 OR n + 1 - up < 30""")
def split_rejects(spark, folder):
    """Failure rows of the split when surfaces of at least 30 points are asked for."""
    rows, hot = _curve(spark, folder)
    _, failures = curves.split_by_step_sign(
        rows.select("curve_id", "ord", "x"), KEY, "x", "ord", shortest=30, hot=hot
    )
    return failures


@book.add("split_at_minimum", f"""
WITH {CURVE}, nose AS (SELECT curve_id, arg_min(ord, (x, ord)) AS nose, max(ord) AS n FROM curve GROUP BY curve_id),
good AS (SELECT * FROM nose WHERE nose >= 5 AND n + 1 - nose >= 5)
SELECT curve_id, 'upper' AS surface, ord, x FROM curve JOIN good USING (curve_id) WHERE ord <= nose
UNION ALL SELECT curve_id, 'lower', ord, x FROM curve JOIN good USING (curve_id) WHERE ord >= nose""")
def split_at_minimum(spark, folder):
    rows, hot = _curve(spark, folder)
    surfaces, _ = curves.split_at_minimum(
        rows.select("curve_id", "ord", "x"), KEY, "x", "ord", hot=hot
    )
    return surfaces.select("curve_id", "surface", "ord", "x")


BRANCHES = f"""{CURVE}, extent AS (SELECT curve_id, min(x) AS lo, max(x) AS hi FROM curve GROUP BY curve_id),
scaled AS (SELECT curve_id, ord, (x - lo) / (hi - lo) AS x, y FROM curve JOIN extent USING (curve_id)
  WHERE hi - lo > 1e-10),
form AS (SELECT curve_id, min(ord) AS f, max(ord) AS l, arg_min(ord, (x, ord)) AS nose,
  arg_min(ord, (-x, ord)) AS tail_first, arg_min(ord, (-x, -ord)) AS tail_last FROM scaled GROUP BY curve_id),
cut AS (SELECT curve_id, CASE WHEN nose = f THEN tail_first WHEN nose = l THEN tail_last ELSE nose END AS cut,
  nose <> f AND nose = l AS backwards FROM form
  WHERE NOT (nose = f AND tail_first = l) AND NOT (nose <> f AND nose = l AND tail_last = f)),
branch AS (
  SELECT curve_id, ord, x, y, NOT backwards AS fore FROM scaled JOIN cut USING (curve_id) WHERE ord <= cut
  UNION ALL SELECT curve_id, ord, x, y, backwards FROM scaled JOIN cut USING (curve_id) WHERE ord >= cut),
side AS (SELECT curve_id, avg(CASE WHEN fore THEN y END) >= avg(CASE WHEN NOT fore THEN y END) AS a_up,
  greatest(min(CASE WHEN fore THEN x END), min(CASE WHEN NOT fore THEN x END)) <= 1e-5 AS attached
  FROM branch GROUP BY curve_id),
branches AS (SELECT curve_id, CASE WHEN fore = a_up THEN 'upper' ELSE 'lower' END AS surface, ord, x, y
  FROM branch JOIN side USING (curve_id) WHERE attached)"""


@book.add("branch_detect", f"WITH {BRANCHES} SELECT curve_id, surface, ord, x, y FROM branches")
def branch_detect(spark, folder):
    rows, hot = _curve(spark, folder)
    branches, _ = curves.detect_branches(
        rows.select("curve_id", "ord", "x", "y"), KEY, "x", "y", "ord", hot
    )
    return branches


def interpolation_sql(samples: str, keys: str, grid: str, columns: str = "y") -> str:
    """Brute-force interpolation: every station against every sample of its curve."""
    return f"""grid AS ({grid}),
ends AS (SELECT {keys}, g.i, g.p, max(CASE WHEN x <= p THEN x END) AS xl, min(CASE WHEN x >= p THEN x END) AS xr,
  arg_max({columns}, CASE WHEN x <= p THEN x END) AS yl, arg_min({columns}, CASE WHEN x >= p THEN x END) AS yr
  FROM {samples}, grid g GROUP BY {keys}, g.i, g.p),
resampled AS (SELECT {keys}, i, CASE WHEN xl IS NULL THEN yr WHEN xr IS NULL THEN yl WHEN xl = p THEN yl
  ELSE yl + (yr - yl) / (xr - xl) * (p - xl) END AS v FROM ends)"""


@book.add("resample_uniform", f"""
WITH {STEP_SIGN}, near AS (
  SELECT *, lag(x) OVER (PARTITION BY curve_id, surface ORDER BY x, ord) AS before FROM surfaces),
samples AS (SELECT curve_id, surface, x, y FROM near WHERE before IS NULL OR x - before > 1e-10),
{interpolation_sql("samples", "curve_id, surface", "SELECT i, (i + 0.5e0) / 32.0e0 AS p FROM (SELECT unnest(range(0, 32)) AS i)")}
SELECT curve_id, surface, CAST(i AS INTEGER) AS i, {r6("v", "y")} FROM resampled""")
def resample_uniform(spark, folder):
    rows, hot = _curve(spark, folder)
    surfaces, _ = curves.split_by_step_sign(
        rows.select("curve_id", "ord", "x", "y"), KEY, "x", "ord", hot=hot
    )
    values, _ = curves.resample_surface(
        surfaces, ["curve_id", "surface"], "x", "ord", ["y"], midcell_stations(32),
        hot=hot.finer(["curve_id", "surface"]),
    )
    return rounded(values.select("curve_id", "surface", F.posexplode("y").alias("i", "y")))


@book.add("resample_cosine", f"""
WITH {BRANCHES}, samples AS (
  SELECT curve_id, surface, x, avg(y) AS y FROM branches GROUP BY curve_id, surface, x),
{interpolation_sql("samples", "curve_id, surface", "SELECT i, 0.5e0 * (1.0e0 - cos(pi() * i / 40.0e0)) AS p FROM (SELECT unnest(range(0, 41)) AS i)")}
SELECT curve_id, CAST(i AS INTEGER) AS i, {r6("max(CASE WHEN surface = 'upper' THEN v END)", "upper_y")},
  {r6("max(CASE WHEN surface = 'lower' THEN v END)", "lower_y")} FROM resampled GROUP BY curve_id, i""")
def resample_cosine(spark, folder):
    rows, hot = _curve(spark, folder)
    branches, _ = curves.detect_branches(
        rows.select("curve_id", "ord", "x", "y"), KEY, "x", "y", "ord", hot
    )
    outline = curves.resample_outline(branches, KEY, "x", "y", cosine_stations(41)).where(
        curves.outline_is_valid(F.col("x"), F.col("upper_y"), F.col("lower_y"))
    )
    pairs = F.posexplode(F.arrays_zip("upper_y", "lower_y"))
    return rounded(
        outline.select("curve_id", pairs.alias("i", "p")).select("curve_id", "i", "p.upper_y", "p.lower_y")
    )


@book.add("ordered_points", f"""
WITH {VEC}, g AS (SELECT i, 0.5e0 * (1.0e0 - cos(pi() * i / 7.0e0)) AS x FROM (SELECT unnest(range(0, 8)) AS i))
SELECT entity_id, CAST(7 - i AS INTEGER) AS place, {r6("x", "x")}, {r6("upper[i + 1]", "y")} FROM vec, g
UNION ALL SELECT entity_id, CAST(7 + i AS INTEGER), {r6("x")}, {r6("lower[i + 1]")} FROM vec, g WHERE i > 0""")
def ordered_points(spark, folder):
    points = curves.ordered_points(literal_array(cosine_stations(8)), F.col("upper"), F.col("lower"))
    rows = vec(spark, folder).select("entity_id", F.posexplode(points).alias("place", "p"))
    return rounded(rows.select("entity_id", "place", "p.x", "p.y"))


@book.add("shape_vectors", f"""
WITH {VEC} SELECT entity_id, CAST(i - 1 AS INTEGER) AS i, list_concat(upper, lower)[i] AS value
FROM vec, (SELECT unnest(range(1, 17)) AS i)""")
def shape_vectors(spark, folder):
    flat = curves.shape_vector(F.col("upper"), F.col("lower"))
    return vec(spark, folder).select("entity_id", F.posexplode(flat).alias("i", "value"))


# -- matching -----------------------------------------------------------------------------------

# Requested values are the events of a user, returned ones the line items of the supplier of the
# same number; users without such a supplier have nothing returned at all.
SIDES = """asked AS (SELECT user_id AS case_id, event_id, value FROM events),
given AS (SELECT l_suppkey AS case_id, l_orderkey AS ord, l_extendedprice / 200.0e0 AS value, l_partkey FROM lineitem)"""


def _sides(spark, folder):
    asked = table(spark, folder, "events").select(
        F.col("user_id").alias("case_id"), "event_id", "value"
    )
    given = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("case_id"), F.col("l_orderkey").alias("ord"),
        (F.col("l_extendedprice") / 200.0).alias("value"), "l_partkey",
    )
    return asked, given


MATCH = f"""{SIDES}, pairs AS (SELECT a.case_id, a.event_id, a.value, g.value AS matched, g.l_partkey,
  row_number() OVER (PARTITION BY a.event_id ORDER BY abs(g.value - a.value), g.ord, g.l_partkey) AS rn
  FROM asked a LEFT JOIN given g ON a.case_id = g.case_id AND abs(g.value - a.value) <= 0.25e0)"""


@book.add("nearest_match", f"""
WITH {MATCH} SELECT case_id, event_id, value, matched, l_partkey FROM pairs WHERE rn = 1""")
def nearest_match(spark, folder):
    asked, given = _sides(spark, folder)
    return matching.nearest_match(
        asked, given, ["case_id"], "value", ["l_partkey"], "ord", tolerance=0.25
    )


@book.add("match_failures", f"""
WITH {MATCH} SELECT case_id, value, 'condition ' || printf('%.3f', value) || ': not returned' AS reason
FROM pairs WHERE rn = 1 AND matched IS NULL""")
def match_failures(spark, folder):
    asked, given = _sides(spark, folder)
    matched = matching.nearest_match(
        asked, given, ["case_id"], "value", ["l_partkey"], "ord", tolerance=0.25
    )
    return matching.unmatched(matched, ["case_id"], "value")


@book.add("failure_preview", f"""
WITH {MATCH} SELECT event_id, case_id FROM pairs WHERE rn = 1 AND matched IS NULL ORDER BY event_id LIMIT 10""")
def failure_preview(spark, folder):
    """The first ten failures by id, as shown when a build fails."""
    asked, given = _sides(spark, folder)
    matched = matching.nearest_match(
        asked, given, ["case_id"], "value", ["l_partkey"], "ord", tolerance=0.25
    )
    failures = matched.where(F.col("matched").isNull()).select("event_id", "case_id")
    return first_failures(failures, "event_id", 10)


@book.add("rounded_key_join", f"""
WITH {SIDES}, keyed AS (SELECT case_id, CAST(round_even(value * 1000, 0) AS BIGINT) AS k, max((ord, l_partkey)) AS hit
  FROM given GROUP BY 1, 2)
SELECT a.case_id, a.event_id, a.value, k.hit[2] AS l_partkey FROM asked a LEFT JOIN keyed k
  ON a.case_id = k.case_id AND CAST(round_even(a.value * 1000, 0) AS BIGINT) = k.k""")
def rounded_key_join(spark, folder):
    asked, given = _sides(spark, folder)
    return matching.rounded_key_join(asked, given, ["case_id"], "value", ["l_partkey"], "ord")


@book.add("resolve_entities", """
WITH specs AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'unknown' ELSE ' CUSTOMER#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS name FROM orders)
SELECT o_orderkey, c.c_mktsegment, CASE WHEN c.c_name IS NULL THEN 'could not resolve the name' END AS reason
FROM specs LEFT JOIN customer c ON lower(trim(specs.name)) = lower(trim(c.c_name))""")
def resolve_entities(spark, folder):
    specs = table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 4 == 0, F.lit("unknown")).otherwise(
            F.concat(F.lit(" CUSTOMER#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
        ).alias("name"),
    )
    catalog = table(spark, folder, "customer").select(F.col("c_name").alias("name"), "c_mktsegment")
    found, failed = matching.resolve_entities(specs, catalog, "name")
    return found.select("o_orderkey", "c_mktsegment", F.lit(None).cast("string").alias("reason")).unionByName(
        failed.select("o_orderkey", F.lit(None).cast("string").alias("c_mktsegment"), "reason")
    )


@book.add("sweep_order", f"""
WITH {CURVE}, s AS (SELECT curve_id, ord, y - 250 AS alpha FROM curve)
SELECT curve_id, alpha, CAST(row_number() OVER (PARTITION BY curve_id ORDER BY
  CASE WHEN abs(alpha) <= 1e-10 THEN 0 WHEN alpha > 0 THEN 1 ELSE 2 END, abs(alpha), ord) AS BIGINT) AS step FROM s""")
def sweep_order(spark, folder):
    rows, hot = _curve(spark, folder)
    swept = rows.select("curve_id", "ord", (F.col("y") - 250).alias("alpha"))
    placed = swept.withColumn("_place", curves.sweep_position(F.col("alpha")))
    return curves.renumber(placed, KEY, ["_place", "ord"], "step", hot).select("curve_id", "alpha", "step")


# -- text and records -----------------------------------------------------------------------------

PARSED = f"""{TEXT}, ls AS (SELECT curve_id, chunk, unnest(string_split(text, chr(10))) AS line,
  unnest(range(1, len(string_split(text, chr(10))) + 1)) AS no FROM text),
words AS (SELECT curve_id, chunk, no, regexp_split_to_array(trim(replace(line, ',', ' ')), ' +') AS w FROM ls),
nums AS (SELECT curve_id, chunk, no, try_cast(w[1] AS DOUBLE) AS x, try_cast(w[2] AS DOUBLE) AS y FROM words),
pairs AS (SELECT *, row_number() OVER (PARTITION BY curve_id, chunk ORDER BY no) AS i,
  count(*) OVER (PARTITION BY curve_id, chunk) AS n FROM nums WHERE x IS NOT NULL AND y IS NOT NULL),
head AS (SELECT curve_id, chunk, max(CASE WHEN i = 1 AND x > 2 AND y > 2 THEN 1 ELSE 0 END) = 1
  AND max(n) > 9 AND max(CASE WHEN i > 1 THEN greatest(abs(x), abs(y)) END) <= 2 AS counted FROM pairs GROUP BY 1, 2)"""


@book.add("parse_pairs", f"""
WITH {PARSED} SELECT curve_id, chunk,
  CAST(row_number() OVER (PARTITION BY curve_id, chunk ORDER BY i) AS INTEGER) AS ord, x, y
FROM pairs JOIN head USING (curve_id, chunk) WHERE n >= 8 AND NOT (counted AND i = 1)""")
def parse_pair_texts(spark, folder):
    parsed = parse_pairs(text(spark, folder, user_load(spark, folder)))
    return point_rows(parsed, ["curve_id", "chunk"])


@book.add("parse_rejects", f"""
WITH {PARSED}, sizes AS (SELECT t.curve_id, t.chunk, count(p.i) AS n FROM text t
  LEFT JOIN pairs p ON t.curve_id = p.curve_id AND t.chunk = p.chunk GROUP BY 1, 2)
SELECT curve_id, chunk, 'at least eight numeric rows are required' AS reason FROM sizes WHERE n < 8""")
def parse_rejects(spark, folder):
    parsed = parse_pairs(text(spark, folder, user_load(spark, folder)))
    return rejected(parsed, ["curve_id", "chunk"])


DUMP = f"""{LINES}, chunks AS (SELECT curve_id, chunk, count(*) AS n FROM lines GROUP BY 1, 2),
dump AS (SELECT curve_id, chunk, ord, CAST(ord AS DOUBLE) AS s, CAST(abs(ord - 32) AS DOUBLE) AS x,
  CAST(whole AS DOUBLE) AS y, CAST(ord + 1 AS DOUBLE) AS ue_vinf, CAST(whole * 3 + 1 AS DOUBLE) AS dstar,
  CAST(ord % 5 AS DOUBLE) AS theta, 7.0e0 AS cf FROM lines)"""


@book.add("parse_dump", f"""
WITH {DUMP} SELECT curve_id, chunk, CAST(row_number() OVER (PARTITION BY curve_id, chunk ORDER BY dump.ord) AS INTEGER) AS ord,
  s, x, y, ue_vinf, dstar, theta, cf, CASE WHEN theta <> 0 THEN dstar / theta END AS "H"
FROM dump JOIN chunks USING (curve_id, chunk) WHERE n >= 8""")
def parse_dump_texts(spark, folder):
    rows, _ = parse_dump(dump_text(spark, folder, user_load(spark, folder)), ["curve_id", "chunk"])
    return rows


@book.add("parse_polar", f"""
WITH {DUMP} SELECT curve_id, chunk, CAST(row_number() OVER (PARTITION BY curve_id, chunk ORDER BY ord) AS INTEGER) AS ord,
  s AS alpha, x AS "CL", y AS "CD", ue_vinf AS "CDp", dstar AS "CM", theta AS "Top_Xtr", cf AS "Bot_Xtr" FROM dump""")
def parse_polar_texts(spark, folder):
    return parse_polar(dump_text(spark, folder, user_load(spark, folder)), ["curve_id", "chunk"])


@book.add("document_pair_counts", """
WITH ls AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x{85}\\x{2028}\\x{2029}]')) AS line FROM documents),
words AS (SELECT doc_id, regexp_split_to_array(regexp_replace(line, '^[\\s,]+', ''), '[\\s,]+') AS w FROM ls),
hits AS (SELECT doc_id, count(*) AS n FROM words WHERE len(w) >= 2
  AND regexp_full_match(w[1], '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')
  AND regexp_full_match(w[2], '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN coalesce(n, 0) < 8 THEN 'at least eight numeric rows are required' END AS reason,
  CASE WHEN coalesce(n, 0) >= 8 THEN CAST(n AS INTEGER) END AS n_points
FROM documents d LEFT JOIN hits USING (doc_id)""")
def document_pair_counts(spark, folder):
    """The tolerant parser over whole documents: which of them hold a coordinate table."""
    parsed = parse_pairs(table(spark, folder, "documents").select("doc_id", "text"))
    return parsed.select(
        "doc_id", "reason", F.when(F.col("reason").isNull(), F.size("points")).alias("n_points")
    )


@book.add("name_stems", r"""
SELECT page_id, lower(regexp_replace(name, '^(.+)\.[^.]*$', '\1')) AS stem,
  lower(regexp_extract(url, '(\.[^./]+)$', 1)) AS suffix
FROM (SELECT page_id, url, string_split(url, '/')[-1] AS name FROM pages)""")
def name_stems(spark, folder):
    """Names and suffixes of resources, as specifications of entities are normalised."""
    return table(spark, folder, "pages").select(
        "page_id", file_stem(F.col("url")).alias("stem"), file_suffix(F.col("url")).alias("suffix")
    )


@book.add("json_properties", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def json_properties(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", records.decode(F.col("props"), "k bigint")["k"].alias("k")
    )


@book.add("json_shape_records", f"""
WITH {VEC} SELECT CAST(entity_id AS VARCHAR) AS name, CAST(i - 1 AS INTEGER) AS i, upper[i] AS upper, lower[i] AS lower,
  le, CASE WHEN entity_id % 3 = 0 THEN 0.0e0 ELSE te END AS te FROM vec, (SELECT unnest(range(1, 9)) AS i)""")
def json_shape_records(spark, folder):
    """Shapes written to JSON and read back; every third record lacks a scalar and gets its default."""
    te = F.when(F.col("entity_id") % 3 != 0, F.col("te"))
    written = vec(spark, folder).select(
        records.shapes_to_json(F.col("entity_id"), F.col("upper"), F.col("lower"), F.col("le"), te).alias("json")
    )
    read = records.shapes_from_json(written, "json").where(F.col("reason").isNull())
    pairs = F.posexplode(F.arrays_zip("upper", "lower"))
    return read.select("name", pairs.alias("i", "p"), "le", "te").select(
        "name", "i", "p.upper", "p.lower", "le", "te"
    )


@book.add("surface_profiles", f"""
WITH {STEP_SIGN}, near AS (
  SELECT *, lag(x) OVER (PARTITION BY curve_id, surface ORDER BY x, ord) AS before FROM surfaces),
samples AS (SELECT curve_id, surface, x, y FROM near WHERE before IS NULL OR x - before > 1e-10),
{interpolation_sql("samples", "curve_id, surface", "SELECT i, (i + 0.5e0) / 32.0e0 AS p FROM (SELECT unnest(range(0, 32)) AS i)")}
SELECT curve_id, CAST(i AS INTEGER) AS i,
  {r6("max(CASE WHEN surface = 'upper' THEN v END) / 100", "upper_bl_theta")},
  {r6("max(CASE WHEN surface = 'upper' THEN v END) * 2", "upper_bl_H")},
  {r6("max(CASE WHEN surface = 'upper' THEN v END) - 1", "upper_bl_ue_vinf")},
  {r6("max(CASE WHEN surface = 'lower' THEN v END) / 100", "lower_bl_theta")},
  {r6("max(CASE WHEN surface = 'lower' THEN v END) * 2", "lower_bl_H")},
  {r6("max(CASE WHEN surface = 'lower' THEN v END) - 1", "lower_bl_ue_vinf")}
FROM resampled GROUP BY curve_id, i""")
def profiles(spark, folder):
    """Six profile arrays per curve, as rows of the training table hold them."""
    rows, hot = _curve(spark, folder)
    samples = rows.select(
        "curve_id", "ord", "x", (F.col("y") / 100).alias("theta"), (F.col("y") * 2).alias("H"),
        (F.col("y") - 1).alias("ue_vinf"),
    )
    wide = surface_profiles(samples, KEY, hot=hot).rows
    names = [f"{s}_bl_{q}" for s in ("upper", "lower") for q in QUANTITIES]
    return rounded(
        wide.select("curve_id", F.posexplode(F.arrays_zip(*names)).alias("i", "p")).select(
            "curve_id", "i", *[f"p.{n}" for n in names]
        )
    )
