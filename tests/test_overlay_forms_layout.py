import datetime

from pyspark.sql import functions as F

from casefuse.operators import distribution as dist
from casefuse.operators import documents as docs
from casefuse.operators import layout as lay
from casefuse.operators import matching as mt
from casefuse.operators import overlay as ov

VALUES = "case_id long, field string, value string"


def as_dict(df):
    return {(r.case_id, r.field): r.value for r in df.collect()}


def test_date_defaults(spark):
    cases = spark.createDataFrame([(1,), (2,)], "case_id long")
    values = spark.createDataFrame([(1, "Fecha", " "), (2, "Fecha", "5"), (2, "de", "mayo"), (2, "año", "4"),
                                    (2, "CP", "1")], VALUES)
    got = as_dict(ov.default_dates(values, cases, datetime.date(2026, 7, 23)))
    assert got == {(1, "Fecha"): "23", (1, "de"): "julio", (1, "año"): "6", (2, "Fecha"): "5",
                   (2, "de"): "mayo", (2, "año"): "4", (2, "CP"): "1"}


def test_copy_block_keeps_the_shop_where_the_source_is_blank(spark):
    values = spark.createDataFrame([(1, "CP", "1"), (1, "Dirección", " "), (1, "Dirección_2", "L"), (1, "NIE", "x")], VALUES)
    assert as_dict(ov.copy_block(values)) == {(1, "CP"): "1", (1, "CP_2"): "1", (1, "Dirección"): " ",
                                              (1, "Dirección_2"): "L", (1, "NIE"): "x"}


def test_checkboxes(spark):
    cases = spark.createDataFrame([(1, "nie"), (2, "otro"), (3, None)], "case_id long, tipo string")
    assert {(r.case_id, r.checkbox, r.state) for r in ov.checkbox_states(cases).collect()} == {
        (1, "CIF", "/Off"), (1, "NIF", "/Off"), (1, "undefined", "/On")}


def test_step_migration(spark):
    df = spark.createDataFrame([(v, s) for v in (0, 1) for s in range(6)], "v int, s int")
    got = [r[0] for r in df.orderBy("v", "s").select(ov.migrate_step(F.col("s"), F.col("v"))).collect()]
    assert got == [0, 1, 2, 2, 3, 0, 0, 1, 2, 3, 4, 5]


def test_one_name_per_canonical_and_one_canonical_per_name(spark):
    names = ["Código CP", "cp", "NIE", "provincia ", "zzz", ""]
    fields = spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "template_id long, ord int, field_name string")
    got = {r.field_name: (r.canonical, r.confidence) for r in mt.assign_canonicals(mt.best_canonical(fields)).collect()}
    assert got == {"Código CP": (None, 0.0), "cp": ("CP", 1.0), "NIE": ("NIE", 1.0),
                   "provincia ": ("Provincia", 1.0), "zzz": (None, 0.0), "": (None, 0.0)}


def test_similarity_scores(spark):
    def score(a, b):
        return spark.range(1).select(mt.name_score(F.lit(a), F.lit(b))).first()[0]
    assert score("a b", "a b") == 1.0 and score("", "a") == 0.0 and score("xaby", "ab") == 0.8
    assert score("b a", "a b") == 0.7 and score("a b c", "c b d") == 0.35
    assert score("xaby", "zz") == 0.0


def test_fingerprint_keeps_repeated_names(spark):
    fields = spark.createDataFrame([(1, "B"), (1, "á"), (1, "b")], "template_id long, field_name string")
    pages = spark.createDataFrame([(1, 7)], "template_id long, n_pages int")
    assert mt.template_fingerprint(fields, pages).first().fingerprint == "7|a,b,b"


def test_long_form_without_labels_uses_every_candidate(spark):
    widgets = spark.createDataFrame([(1, "f", p) for p in (0, 4, 9)] + [(1, "g", 5)], "doc_id long, field_name string, page_no int")
    size = spark.createDataFrame([(1, 30)], "doc_id long, n_pages int")
    cand = lay.candidate_pages(lay.multipage_pages(widgets), size)
    none = spark.createDataFrame([], "doc_id long, page_no int, anchor double")
    assert sorted(r.page_no for r in lay.signature_pages(cand, none).collect()) == [4, 9, 23]
    one = spark.createDataFrame([(1, 9, 0.93)], "doc_id long, page_no int, anchor double")
    placed = lay.placements(lay.signature_pages(cand, one)).collect()
    assert [(r.page_no, r.x, r.y) for r in placed] == [(9, 0.3, 0.95)]


def test_stamp_fits_the_box_by_its_limiting_side(spark):
    rows = [(1, 0, 1, .5, .5, .2, .1, 1000., 500., a) for a in (1.0, 0.1)] + [(1, 3, 1, .5, .5, .2, .1, 1000., 500., 1.)]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, n_pages int, x double, y double, w double, h double, "
                                     "page_width double, page_height double, aspect double")
    got = [(r.draw_w, r.draw_h, r.draw_x, r.draw_y) for r in lay.fit_in_box(df).collect()]
    assert got == [(50., 50., 475., 225.), (200., 20., 400., 240.)]


def test_batches_of_twenty(spark):
    rows = [(1, d, p) for d, n in ((1, 20), (2, 21), (3, 40)) for p in range(n)]
    pages = spark.createDataFrame(rows, "case_id long, doc_id long, page_no long")
    got = docs.page_batches(pages, F.concat(F.lit("f"), "doc_id"), rows=7).select("doc_id", "batch_no", "label").distinct()
    assert {tuple(r) for r in got.collect()} == {
        (1, 1, "f1"), (2, 1, "f2 (parte 1/2)"), (2, 2, "f2 (parte 2/2)"), (3, 1, "f3 (parte 1/2)"), (3, 2, "f3 (parte 2/2)")}


def test_restore_warning_is_exact(spark):
    stored = spark.createDataFrame([(1, f"a/{'x' * (i % 3)}", i) for i in range(200)], "case_id long, uri string, seq long")
    listing = spark.createDataFrame([("b",)], "uri string")
    want = ", ".join("x" * (i % 3) for i in range(200))[:120]
    assert docs.restore_warnings(stored, listing).first().names == want


def _otsu(bins):
    hist = [bins.count(i) for i in range(256)]
    n, total = len(bins), sum(bins)
    best, thr, wb, sb = 0.0, 170, 0, 0.0
    for t in range(256):
        wb += hist[t]
        sb += t * hist[t]
        if wb == 0:
            continue
        if n - wb == 0:
            break
        gap = sb / wb - (total - sb) / (n - wb)
        if wb * (n - wb) * gap * gap > best:
            best, thr = wb * (n - wb) * gap * gap, t
    return min(230, max(60, thr))


def test_otsu_equals_brute_force(spark):
    import random
    rnd = random.Random(5)
    groups = {1: [rnd.choice([20, 90, 91, 200, rnd.randrange(256)]) for _ in range(300)], 2: [7] * 5, 3: [0, 255]}
    df = spark.createDataFrame([(g, b) for g, bins in groups.items() for b in bins], "group_id int, bin int")
    got = {r.group_id: r.threshold for r in dist.otsu_threshold(df).collect()}
    assert got == {g: _otsu(b) for g, b in groups.items()}


def test_ruled_lines(spark):
    metric = {0: 80, 1: 90, 40: 78, 41: 70, 50: 95, 60: 76, 61: 76, 62: 76, 63: 76, 64: 99}
    series = spark.createDataFrame([(1, p, metric.get(p, 3)) for p in range(100)], "series_id long, pos long, metric long")
    dims = spark.createDataFrame([(1, 100, 100)], "series_id long, span long, total long")
    got = {(r.start_pos, r.end_pos): r.is_line for r in dist.frame_lines(series, dims, rows=7).collect()}
    assert got == {(0, 1): True, (40, 40): False, (50, 50): True, (60, 64): False}


def test_page_edits_follow_their_order(spark):
    from casefuse.operators import layout
    pages = spark.createDataFrame([(1, 4), (1, 7)], "doc_id long, page_no int")
    edits = spark.createDataFrame(
        [(1, 5, 1, "remove"), (1, 5, 2, "add"), (1, 4, 3, "add"), (1, 4, 4, "remove"), (1, -1, 5, "add")],
        "doc_id long, page_no int, seq long, action string")
    got = layout.adjust_pages(pages, edits).collect()
    assert {(r.doc_id, r.page_no) for r in got} == {(1, 5), (1, 7)}
    stamps = spark.createDataFrame([(1, 4), (1, 5), (1, 7)], "doc_id long, page_no int")
    assert [r.page_no for r in layout.kept_stamps(stamps, edits).collect()] == [7]


def test_document_files_are_read_below_a_folder(spark, tmp_path):
    from casefuse.sources.tables import read_document_files
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.pdf").write_bytes(b"one")
    (tmp_path / "sub" / "b.pdf").write_bytes(b"three")
    (tmp_path / "c.txt").write_bytes(b"x")
    rows = read_document_files(spark, str(tmp_path), "*.pdf").collect()
    assert {(r.uri.rsplit("/", 1)[1], r.n_bytes, bytes(r.content)) for r in rows} == {
        ("a.pdf", 3, b"one"), ("b.pdf", 5, b"three")}


def test_unnamed_documents_are_called_by_their_place(spark):
    from pyspark.sql import functions as F
    from casefuse.operators import documents
    pages = spark.createDataFrame(
        [(1, 9, 0, 3), (1, 9, 1, 4), (1, 2, 0, 5), (2, 7, 0, 1)], "case_id long, doc_id long, page_no long, seq long")
    places = documents.document_ordinals(pages, "seq")
    rows = documents.page_batches(pages.join(places, ["case_id", "doc_id"]), F.lit(" "), ordinal=F.col("ordinal"))
    assert {(r.case_id, r.doc_id, r.label) for r in rows.collect()} == {
        (1, 9, "documento 1"), (1, 2, "documento 2"), (2, 7, "documento 1")}


def test_two_saves_in_one_millisecond_are_two_entries(spark):
    from casefuse.sources.history import list_history
    log = spark.createDataFrame([
        (1, "h_a", '{"label":"x","campos":{"CP":"1"}}', 0, False), (2, "h_a", '{"label":"y","campos":{}}', 0, False),
        (3, "h_b", '{"label":', 0, False), (2, "h_b", '{"label":"z","campos":{}}', 0, False), (2, "h_b", None, 1, True)],
        "owner long, id string, json string, op_seq int, deleted boolean")
    assert [(r.owner, r.label, r.n_fields) for r in list_history(log).collect()] == [(1, "x", 1), (2, "y", 0)]
