"""Schema matching and page layout."""

from pyspark.sql import functions as F

from bindings.common import query, table
from casefuse import fixed_values as fv
from casefuse.operators import layout as lay
from casefuse.operators import matching as mt
from casefuse.plans.forms import match_forms, signature_layout

CANON = ["red widget", "widget", "cold", "gear red", "hot ring big", "Ánvil  old"]
_CANON_SQL = "(VALUES " + ", ".join(
    f"({i}, '{c}', trim(regexp_replace(lower(strip_accents('{c}')), '\\s+', ' ', 'g')))" for i, c in enumerate(CANON)) + ") AS c(cord, canonical, cf)"
_FOLD = "trim(regexp_replace(lower(strip_accents({})), '\\s+', ' ', 'g'))"
# A template is a brand and size; its fields are its parts' names.
# A form for each brand, size and block of parts, so that its number of fields does not grow.
_TEMPLATE = "p_brand || '-' || p_size || '-' || cast(floor(p_partkey / 50000) as bigint)"
_FIELDS = [f"{_TEMPLATE} as template_id", "min(p_partkey) as ord", "p_name as field_name"]
_FIELDS_SQL = f"fields AS (SELECT {_TEMPLATE} AS template_id, min(p_partkey) AS ord, p_name AS field_name FROM part GROUP BY ALL)"
_BEST = f"""{_FIELDS_SQL},
scored AS (SELECT f.*, canonical, cord, CASE WHEN rf = cf THEN 1.0 WHEN rf = '' OR cf = '' THEN 0.0
    WHEN contains(rf, cf) OR contains(cf, rf) THEN 0.8
    ELSE round(0.7 * len(list_intersect(string_split(rf, ' '), string_split(cf, ' ')))
               / len(list_distinct(list_concat(string_split(rf, ' '), string_split(cf, ' ')))), 6) END AS score
  FROM (SELECT *, {_FOLD.format('field_name')} AS rf FROM fields) f, {_CANON_SQL}),
best AS (SELECT template_id, ord, field_name, canonical, CAST(score AS DOUBLE) AS score FROM scored
         QUALIFY row_number() OVER (PARTITION BY template_id, field_name ORDER BY score DESC, cord) = 1)"""
_ASSIGNED = f"""{_BEST},
won AS (SELECT template_id, field_name FROM best WHERE score >= 0.5
        QUALIFY row_number() OVER (PARTITION BY template_id, canonical ORDER BY score DESC, ord) = 1),
assigned AS (SELECT b.template_id, b.ord, b.field_name, CASE WHEN w.field_name IS NOT NULL THEN canonical END AS canonical,
    CASE WHEN w.field_name IS NOT NULL THEN score ELSE 0.0 END AS confidence
  FROM best b LEFT JOIN won w ON b.template_id = w.template_id AND b.field_name = w.field_name)"""


def _fields(spark, sf):
    return table(spark, sf, "part").groupBy(F.expr(_TEMPLATE).alias("template_id"), F.col(
        "p_name").alias("field_name")).agg(F.min("p_partkey").alias("ord"))


@query("name_similarity", f"WITH {_BEST} SELECT DISTINCT field_name, canonical, CAST(score AS DOUBLE) AS score FROM scored")
def name_similarity(spark, sf):
    names = table(spark, sf, "part").select("p_name").distinct()
    return names.select(F.col("p_name").alias("field_name"), F.explode(
        mt.score_canonicals(F.col("p_name"), CANON)).alias("s")).select("field_name", "s.canonical", "s.score")


@query("best_canonical", f"WITH {_BEST} SELECT template_id, field_name, canonical, score FROM best")
def best_canonical(spark, sf):
    return mt.best_canonical(_fields(spark, sf), CANON).drop("ord")


@query("assigned_canonicals", f"WITH {_ASSIGNED} SELECT template_id, ord, field_name, canonical, CAST(confidence AS DOUBLE) AS confidence FROM assigned")
def assigned_canonicals(spark, sf):
    return mt.assign_canonicals(mt.best_canonical(_fields(spark, sf), CANON))


_PRINTS = f"""raw AS (SELECT {_TEMPLATE} AS template_id, p_name AS field_name FROM part),
prints AS (SELECT template_id, (count(*) % 5 + 1) || '|' || string_agg({_FOLD.format('field_name')}, ',' ORDER BY {_FOLD.format('field_name')}) AS fingerprint
           FROM raw GROUP BY template_id)"""


def _raw_fields(spark, sf):
    raw = table(spark, sf, "part").selectExpr(f"{_TEMPLATE} as template_id", "p_name as field_name")
    pages = raw.groupBy("template_id").agg((F.count(F.lit(1)) % 5 + 1).alias("n_pages"))
    return raw, pages


@query("template_fingerprints", f"WITH {_PRINTS} SELECT * FROM prints")
def template_fingerprints(spark, sf):
    return mt.template_fingerprint(*_raw_fields(spark, sf))


_SAVED = f"""{_ASSIGNED}, {_PRINTS},
saved AS (SELECT DISTINCT fingerprint, 'widget' AS canonical, 'saved ' || length(fingerprint) AS real FROM prints WHERE length(fingerprint) % 3 = 0),
mapping AS (SELECT p.template_id, canonical, real, false AS needs_review FROM prints p JOIN saved USING (fingerprint)
  UNION ALL SELECT template_id, canonical, field_name, true FROM assigned WHERE canonical IS NOT NULL
    AND template_id NOT IN (SELECT template_id FROM prints JOIN saved USING (fingerprint)))"""


def _mapping(spark, sf):
    raw, pages = _raw_fields(spark, sf)
    saved = mt.template_fingerprint(raw, pages).where("length(fingerprint) % 3 = 0").selectExpr(
        "fingerprint", "'widget' as canonical", "'saved ' || length(fingerprint) as real").distinct()
    fields = _fields(spark, sf)
    assigned = mt.assign_canonicals(mt.best_canonical(fields, CANON))
    return mt.apply_saved_mapping(
        assigned.select("template_id", "canonical", F.col("field_name").alias("real")),
        mt.template_fingerprint(raw, pages), saved)


@query("saved_mapping_wins", f"WITH {_SAVED} SELECT template_id, canonical, real, needs_review FROM mapping")
def saved_mapping_wins(spark, sf):
    return _mapping(spark, sf)


@query("form_matching", f"""WITH {_ASSIGNED}
SELECT template_id, canonical, field_name AS real, true AS needs_review FROM assigned WHERE canonical IS NOT NULL""")
def form_matching(spark, sf):
    fields = _fields(spark, sf)
    pages = fields.groupBy("template_id").agg(F.count(F.lit(1)).alias("n_pages"))
    saved = fields.selectExpr("'none' as fingerprint", "'x' as canonical", "field_name as real").distinct()
    return match_forms(fields, pages, saved, CANON)


_CHANGES = f"SELECT DISTINCT {_TEMPLATE} AS template_id, CASE WHEN p_size % 2 = 0 THEN 'widget' ELSE 'cold' END AS canonical, " \
           "CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'hand ' || p_size END AS real FROM part"


@query("mapping_overrides", f"""WITH {_SAVED}, changes AS ({_CHANGES}),
changed AS (SELECT coalesce(c.template_id, m.template_id) AS template_id, coalesce(c.canonical, m.canonical) AS canonical,
         CASE WHEN c.template_id IS NOT NULL THEN c.real ELSE m.real END AS real
         FROM mapping m FULL JOIN changes c ON m.template_id = c.template_id AND m.canonical = c.canonical)
SELECT * FROM changed WHERE real IS NOT NULL""")
def mapping_overrides(spark, sf):
    changes = table(spark, sf, "part").selectExpr(
        f"{_TEMPLATE} as template_id", "case when p_size % 2 = 0 then 'widget' else 'cold' end as canonical",
        "case when p_size % 3 = 0 then null else 'hand ' || p_size end as real").distinct()
    return mt.override_mapping(_mapping(spark, sf), changes)


_ALL_CANON = ", ".join(f"({i}, '{k}')" for i, (k, *_) in enumerate(fv.FIELD_CATALOG))


@query("effective_fields", f"""WITH {_FIELDS_SQL}, templates AS (SELECT DISTINCT {_TEMPLATE} AS template_id, p_size FROM part)
SELECT template_id, field_name, ord FROM fields
UNION ALL SELECT template_id || ' new', k.field_name, k.ord FROM templates, (VALUES {_ALL_CANON}) AS k(ord, field_name) WHERE p_size % 4 = 0""")
def effective_fields(spark, sf):
    part = table(spark, sf, "part")
    own = part.groupBy(F.expr(_TEMPLATE).alias("template_id"), F.col(
        "p_name").alias("field_name")).agg(F.min("p_partkey").alias("ord"))
    templates = part.selectExpr("explode(case when p_size % 4 = 0 then array('', ' new') else array('') end) as kind",
                                f"{_TEMPLATE} as id").selectExpr("id || kind as template_id")
    return mt.effective_fields(templates, own)


# Widgets and text fragments of forms: a supplier is a form, its line items are widgets.
_N = "(10 + l_suppkey % 30)"
_WIDGETS = ["l_suppkey as doc_id", "'f' || (l_partkey % 300) as field_name", f"l_orderkey % {_N} as page_no"]
_FRAGMENTS = ["l_suppkey as doc_id", f"l_orderkey % {_N} as page_no",
              "case when l_returnflag = 'R' and l_suppkey % 5 <> 0 and l_orderkey % 3 = 0 then 'Firma: El Distribuidor' "
              "when l_returnflag = 'N' then 'Los Distribuidores' else 'otro' end as text",
              "l_discount * 10000 as y", "842.0e0 as page_height"]
_LAYOUT = f"""w AS (SELECT {', '.join(_WIDGETS)} FROM lineitem),
frag AS (SELECT {', '.join(_FRAGMENTS).replace('842.0e0', 'CAST(842 AS DOUBLE)')} FROM lineitem),
size AS (SELECT s_suppkey AS doc_id, 10 + s_suppkey % 30 AS n_pages FROM supplier),
multi AS (SELECT doc_id, field_name, count(DISTINCT page_no) AS n_pages FROM w GROUP BY ALL HAVING count(DISTINCT page_no) > 1),
cand AS (SELECT DISTINCT doc_id, page_no FROM w SEMI JOIN multi USING (doc_id, field_name) WHERE page_no <> 0
         UNION SELECT doc_id, 23 FROM size WHERE n_pages >= 24),
anch AS (SELECT doc_id, page_no, min(least(greatest(y / page_height, 0.0), 1.0)) AS anchor FROM frag
         WHERE contains(upper(text), 'DISTRIBUIDOR') AND NOT contains(upper(text), 'DISTRIBUIDORES') GROUP BY ALL),
joined AS (SELECT c.*, a.anchor, count(a.anchor) OVER (PARTITION BY c.doc_id) AS strong FROM cand c LEFT JOIN anch a ON a.doc_id = c.doc_id AND a.page_no = c.page_no),
sign AS (SELECT doc_id, page_no, anchor FROM joined WHERE strong = 0 OR anchor IS NOT NULL),
calib(page_no, cx, cy, cw, ch) AS (VALUES {', '.join(f'({p}, {x}, {y}, {w}, {h})' for p, (x, y, w, h) in fv.CALIBRATED_PLACEMENTS.items())}),
placed AS (SELECT doc_id, s.page_no, round(CAST(coalesce(cx, 0.30) AS DOUBLE), 6) AS x, round(CAST(coalesce(cy, least(anchor + 0.06, 0.95), 0.82) AS DOUBLE), 6) AS y,
    CAST(coalesce(cw, 0.28) AS DOUBLE) AS w, CAST(coalesce(ch, 0.114) AS DOUBLE) AS h FROM sign s LEFT JOIN calib c ON c.page_no = s.page_no)"""


def _layout(spark, sf):
    line = table(spark, sf, "lineitem")
    size = table(spark, sf, "supplier").selectExpr("s_suppkey as doc_id", "10 + s_suppkey % 30 as n_pages")
    return line.selectExpr(*_WIDGETS), line.selectExpr(*_FRAGMENTS), size


@query("multipage_fields", f"WITH {_LAYOUT} SELECT * FROM multi")
def multipage_fields(spark, sf):
    return lay.multipage_fields(_layout(spark, sf)[0])


@query("candidate_pages", f"WITH {_LAYOUT} SELECT * FROM cand")
def candidate_pages(spark, sf):
    widgets, _, size = _layout(spark, sf)
    return lay.candidate_pages(lay.multipage_pages(widgets), size)


@query("page_anchors", f"WITH {_LAYOUT} SELECT doc_id, page_no, round(anchor, 6) AS anchor FROM anch")
def page_anchors(spark, sf):
    return lay.page_anchors(_layout(spark, sf)[1])


@query("signature_pages", f"WITH {_LAYOUT} SELECT doc_id, page_no, round(anchor, 6) AS anchor FROM sign")
def signature_pages(spark, sf):
    widgets, fragments, size = _layout(spark, sf)
    return lay.signature_pages(lay.candidate_pages(lay.multipage_pages(widgets), size), lay.page_anchors(fragments))


@query("signature_placements", f"WITH {_LAYOUT} SELECT * FROM placed")
def signature_placements(spark, sf):
    return signature_layout(*_layout(spark, sf))


_STAMPS = ["l_orderkey as doc_id", f"l_suppkey % 40 as page_no", f"cast({_N} as bigint) as n_pages",
           "l_discount * 5 as x", "l_tax * 10 as y", "0.256e0 as w", "0.114e0 as h",
           "600.0e0 as page_width", "l_extendedprice / 128 + 100 as page_height", "l_quantity / 25 as aspect"]
_STAMPS_SQL = ", ".join(_STAMPS).replace("0.256e0", "CAST(0.256 AS DOUBLE)").replace(
    "0.114e0", "CAST(0.114 AS DOUBLE)").replace("600.0e0", "CAST(600 AS DOUBLE)")


@query("fitted_stamps", f"""
WITH s AS (SELECT {_STAMPS_SQL} FROM lineitem),
b AS (SELECT *, w * page_width AS bw, h * page_height AS bh FROM s WHERE page_no < n_pages),
d AS (SELECT *, CASE WHEN aspect > bh / bw THEN bh / aspect ELSE bw END AS dw, CASE WHEN aspect > bh / bw THEN bh ELSE bw * aspect END AS dh FROM b)
SELECT doc_id, page_no, CAST(floor(dw * 1000) AS BIGINT) AS w, CAST(floor(dh * 1000) AS BIGINT) AS h,
       CAST(floor((x * page_width - dw / 2) * 1000) AS BIGINT) AS x, CAST(floor(((1 - y) * page_height - dh / 2) * 1000) AS BIGINT) AS y FROM d""")
def fitted_stamps(spark, sf):
    fitted = lay.fit_in_box(table(spark, sf, "lineitem").selectExpr(*_STAMPS))
    milli = lambda c: F.floor(F.col(c) * 1000)
    return fitted.select("doc_id", "page_no", milli("draw_w").alias("w"), milli("draw_h").alias("h"),
                         milli("draw_x").alias("x"), milli("draw_y").alias("y"))


_EDIT_SEQ = "l_orderkey * 8 + l_linenumber AS seq"
_ADDED = f"SELECT l_suppkey AS doc_id, l_linenumber + l_suppkey % 9 - 3 AS page_one_based, {_EDIT_SEQ} FROM lineitem"
_REMOVED = f"SELECT l_suppkey AS doc_id, l_partkey % 6 AS page_no, {_EDIT_SEQ} FROM lineitem WHERE l_returnflag = 'A'"


def _page_edits(spark, sf):
    """Pages added and removed by hand, in the order of the lines."""
    line = table(spark, sf, "lineitem")
    added = line.selectExpr("l_suppkey as doc_id", "l_linenumber + l_suppkey % 9 - 4 as page_no", _EDIT_SEQ,
                            "'add' as action")
    return added.unionByName(line.where("l_returnflag = 'A'").selectExpr(
        "l_suppkey as doc_id", "l_partkey % 6 as page_no", _EDIT_SEQ, "'remove' as action"))




@query("adjusted_pages", f"""WITH {_LAYOUT}, added AS ({_ADDED}), removed AS ({_REMOVED}),
edits AS (SELECT doc_id, page_one_based - 1 AS page_no, seq, 'add' AS action FROM added
          UNION ALL SELECT doc_id, page_no, seq, 'remove' FROM removed),
log AS (SELECT doc_id, page_no, -1 AS seq, 'add' AS action FROM sign UNION ALL SELECT * FROM edits WHERE page_no >= 0)
SELECT doc_id, page_no FROM (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY doc_id, page_no ORDER BY seq DESC, action DESC) = 1)
WHERE action = 'add'""")
def adjusted_pages(spark, sf):
    widgets, fragments, size = _layout(spark, sf)
    pages = lay.signature_pages(lay.candidate_pages(lay.multipage_pages(widgets), size), lay.page_anchors(fragments))
    return lay.adjust_pages(pages, _page_edits(spark, sf))


@query("kept_stamps", f"""WITH {_LAYOUT}, removed AS ({_REMOVED})
SELECT doc_id, page_no, round(x, 6) AS x, round(y, 6) AS y FROM placed ANTI JOIN removed USING (doc_id, page_no)""")
def kept_stamps(spark, sf):
    return lay.kept_stamps(signature_layout(*_layout(spark, sf)), _page_edits(spark, sf)).select(
        "doc_id", "page_no", "x", "y")


_MOVES = ["o_custkey % 100 as doc_id", "o_orderkey % 40 as page_no", "o_orderkey as seq",
          "o_totalprice / 524288 - 0.1e0 as x", "o_totalprice / 262144 as y"]


@query("moved_stamps", f"""WITH {_LAYOUT},
moves AS (SELECT {', '.join(_MOVES).replace('0.1e0', 'CAST(0.1 AS DOUBLE)')} FROM orders),
last AS (SELECT * FROM moves QUALIFY row_number() OVER (PARTITION BY doc_id, page_no ORDER BY seq DESC) = 1)
SELECT coalesce(p.doc_id, m.doc_id) AS doc_id, coalesce(p.page_no, m.page_no) AS page_no,
  round(coalesce(least(greatest(m.x, 0.0), 1.0), p.x), 6) AS x, round(coalesce(least(greatest(m.y, 0.0), 1.0), p.y), 6) AS y,
  coalesce(w, CAST(0.256 AS DOUBLE)) AS w, coalesce(h, CAST(0.114 AS DOUBLE)) AS h
FROM placed p FULL JOIN last m ON p.doc_id = m.doc_id AND p.page_no = m.page_no""")
def moved_stamps(spark, sf):
    moves = table(spark, sf, "orders").selectExpr(*_MOVES)
    return lay.move_stamps(signature_layout(*_layout(spark, sf)), moves)


_CROPS = ["o_orderkey", "o_orderkey % 130 - 10 as x", "o_custkey % 110 as y", "o_orderkey % 97 as w", "o_custkey % 120 as h",
          "cast(o_orderkey % 800 + 1 as int) as width", "cast(o_custkey % 900 + 1 as int) as height"]


def _clamp(v, low, high):
    return f"least(greatest({v}, {low}), {high})"


@query("pixel_boxes", f"""
WITH b AS (SELECT {', '.join(_CROPS)} FROM orders),
p AS (SELECT *, CAST(trunc(CAST(x AS DOUBLE) / 100 * width) AS BIGINT) AS rx, CAST(trunc(CAST(y AS DOUBLE) / 100 * height) AS BIGINT) AS ry,
  CAST(trunc(CAST(w AS DOUBLE) / 100 * width) AS BIGINT) AS rw, CAST(trunc(CAST(h AS DOUBLE) / 100 * height) AS BIGINT) AS rh FROM b),
q AS (SELECT *, {_clamp('rx', 0, 'width - 1')} AS px, {_clamp('ry', 0, 'height - 1')} AS py FROM p)
SELECT o_orderkey, px AS x, py AS y, {_clamp('rw', 1, 'width - px')} AS w, {_clamp('rh', 1, 'height - py')} AS h FROM q""")
def pixel_boxes(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(*_CROPS)
    return rows.select("o_orderkey", lay.pixel_box(*[F.col(c) for c in (
        "x", "y", "w", "h", "width", "height")]).alias("b")).select("o_orderkey", "b.*")
