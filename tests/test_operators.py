import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import amend, models, pages, payload, render
from folioflow.sources import documents as src
from folioflow.streaming import events as ev


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize("given_, want", [("  ν. 4622/2019 ", "ν.-46222019"), (None, "untitled"), ("", "untitled"), ("!!!", "untitled"), ("a b\tc", "a-b-c")])
def test_slug(spark, given_, want):
    assert one(spark, given_, T.slugify) == want


@pytest.mark.parametrize("make, given_, want", [(T.text_quality, "αβγ@@", 0.6), (T.text_quality, "", 0.0), (T.greek_date, "8 Ιανουαρίου 2026", "2026-01-08"), (T.greek_date, "8 Μαΐου 2026", None), (T.dot_date, "31.02.2026", "2026-02-31"), (T.escape_markup, 'a<b & "c"', "a&lt;b &amp; &quot;c&quot;"), (T.image_category, "It is a TABLE.", "table"), (T.image_category, "?", "photo"), (T.strip_fence, "```json\n{}\n```", "{}")])
def test_golden_values(spark, make, given_, want):
    assert one(spark, given_, make) == want


def test_lists(spark):
    assert [tuple(x) for x in one(spark, "x: α) foo β) bar", T.alpha_list)] == [("α", "foo"), ("β", "bar")]
    assert [x["number"] for x in one(spark, "1. άρθρο 45. του ν. 4622/2019. 2. β", T.numbered_items)] == ["1", "45", "2019", "2"]
    assert one(spark, "Ο Πρωθυπουργός ΑΒ Γ", T.signatures).premier == "ΑΒ Γ"


@pytest.mark.parametrize("raw, compat, limit, want", [("pre[PAGE 1]a[PAGE 2]b", True, 6000, ["[PAGE 1]a[PAGE 2]bb"]), ("pre[PAGE 1]a[PAGE 2]b", False, 6000, ["pre[PAGE 1]a[PAGE 2]b"]), ("x" * 7000, True, 6000, ["x" * 7000]), ("", True, 6000, [""]), ("[PAGE 1]aaaa[PAGE 2]bbbb", True, 14, ["[PAGE 1]aaaa", "[PAGE 2]bbbb", "bbbb"][:2] + ["bbbb"])])
def test_chunks(spark, raw, compat, limit, want):
    assert one(spark, raw, lambda c: pages.pack(pages.segments(c, compat), limit)) == want


@pytest.mark.parametrize(
    "text, op, old, new, conf, want, notes",
    [
        ("abcb", "replace", "b", "X", 0.9, "aXcb", []),
        ("t", "insert", "", "n", 0.9, "t\n\nn", []),
        ("abc", "delete", "zz", "", 0.9, "abc", ["delete failed in amendment #1: old_text not found"]),
        ("abc", "add", "a", "b", 0.9, "abc", ["unknown operation in amendment #1"]),
        ("abc", "replace", "b", "B", None, "aBc", ["amendment #1 low confidence (0.00)"]),
        ("abc", None, None, None, 0.9, "abc", ["unknown operation in amendment #1"]),
        (None, "insert", None, None, 0.8, "\n\n", []),
    ],
)
def test_amendments(spark, text, op, old, new, conf, want, notes):
    df = spark.createDataFrame([(text, [(op, old, new, conf)])], "t string, a array<struct<operation:string,old_text:string,new_text:string,confidence:double>>")
    r = df.select(amend.apply_amendments(F.col("t"), F.col("a")).alias("r")).first()["r"]
    assert (r.text, list(r.notes)) == (want, notes)


def test_unified_diff():
    got = amend.unified_diff.func(pd.Series(["a\nb", "x"]), pd.Series(["a\nc", "x"]))
    assert got[0] == "--- current\n+++ updated\n@@ -1,2 +1,2 @@\n a\n-b+c" and got[1] == ""


@given(st.recursive(st.none() | st.integers() | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=6))
@settings(max_examples=60, deadline=None)
def test_repair_keeps_whole_objects(value):
    import json

    whole = json.dumps({"k": value}, ensure_ascii=False)
    assert json.loads(payload.repair("Reply:\n" + whole)) == {"k": value}


@pytest.mark.parametrize("raw, compat, want", [('{"a":[{"b":1', True, None), ('{"a":[{"b":1', False, '{"a": [{"b": 1}]}'), ('{"a": 1,', True, '{"a": 1}'), ("[1]", True, None), (None, True, None), ('{"a": 1, "b": "x', True, '{"a": 1}')])
def test_repair(raw, compat, want):
    assert payload.repair(raw, compat) == want
    if raw == '{"a":[{"b":1':
        assert payload.balance(raw) == '{"a":[{"b":1]}}'


def test_model_ranking(spark):
    rows = [("h", n, i, 6.0) for i, n in enumerate(["zeta", "phi3:mini", "mistral:7b", "qwen2.5:3b"])]
    df = spark.createDataFrame(rows, "host string, name string, list_pos int, free_gb double")
    ranked = [r.name for r in models.candidates(df).orderBy("sort_key").collect()]
    assert ranked == ["qwen2.5:3b", "phi3:mini", "mistral:7b", "zeta"]
    assert models.choose(df).first().downgraded


def test_html_and_diff_view(spark):
    df = spark.createDataFrame([("<t>", [("heading", "h&"), ("other", None)], ["s"])], "t string, s array<struct<kind:string,text:string>>, g array<string>")
    out = df.select(render.html(F.col("t"), F.lit("1"), F.lit("law"), F.lit("2026-01-08"), F.col("s"), F.col("g")).alias("o")).first()["o"]
    for part in ("<h1>&lt;t&gt;</h1>", "<h2>h&amp;</h2>", "<p></p>", "<strong>Date:</strong> 2026-01-08", "<p>s</p>"):
        assert part in out
    shown = one(spark, "--- a\n+b\n c\n", lambda c: render.diff_html(F.lit("L"), c))
    assert shown.count("diff-removed") == 1 and shown.count("diff-added") == 1 and shown.endswith("</div>\n</div>")


def test_pages_isolate_failures(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"p1\fp2")
    (tmp_path / "b.pdf").write_bytes(b"bad")
    (tmp_path / "c.txt").write_bytes(b"no")

    def convert(raw):
        if raw == b"bad":
            raise ValueError("broken")
        return raw.decode().split("\f")

    got = src.pages(src.pdf_files(spark, str(tmp_path)), convert).collect()
    assert sorted((r.page_num or 0, r.text or r.error) for r in got) == [(0, "ValueError: broken"), (1, "p1"), (2, "p2")]


def test_column_divider():
    import numpy as np

    grid = np.zeros((10, 100), np.uint8)
    grid[:, 47] = 255
    got = src.column_divider.func(pd.Series([100, 100, 0]), pd.Series([grid.tobytes(), b"\0" * 1000, b""]))
    assert got.two_columns.tolist() == [True, False, False] and got.column_x[0] == 94


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, i % 3, "insert", "", f"n{i}", 0.9, i // 4) for i in range(12)]
    schema = "event_id bigint, law_id bigint, operation string, old_text string, new_text string, confidence double, ts bigint"
    df = spark.createDataFrame(rows, schema)
    for k in range(3):
        df.where(f"ts = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ev.law_state(spark, stream, str(tmp_path / "laws"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    want = {r.law_id: r.text for r in amend.fold_laws(df, "law_id", ["ts", "event_id"]).collect()}
    assert {r.law_id: r.text for r in ev.laws_now(spark, str(tmp_path / "laws")).collect()} == want
    assert sorted(p.name for p in (tmp_path / "laws").iterdir()) == ["batch=1", "batch=2"]


def test_catalogue_is_whole():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(q) > 40


def test_merged_chunks_keep_amendments_and_the_first_chunks_fields(spark):
    from folioflow.operators import payload

    kind = "doc int, i int, title string, sections array<string>, signatures array<string>, publication_date string, confidence double, amendments array<struct<operation:string,old_text:string>>, document_id string, document_type string"
    rows = [(1, 2, "b", ["s2"], [], "d", 0.9, [("delete", "y"), ("insert", "z")], "id2", "other"), (1, 1, "a", ["s1"], ["n"], "", 0.5, [("replace", "x")], "id1", "act"), (1, 3, "c", ["s3"], [], "", 0.1, None, "id3", "act")]
    got = payload.merge_chunks(spark.createDataFrame(rows, kind), "doc", "i").collect()[0]
    assert [tuple(a) for a in got.amendments] == [("replace", "x"), ("delete", "y"), ("insert", "z")]
    assert (got.document_id, got.document_type, got.title, got.publication_date, got.sections) == ("id1", "act", "a", "d", ["s1", "s2", "s3"])


#: a cabinet act's payload: two reasons, one with letters, two articles without titles, three members
ACT = {
    "document_type": "cabinet_act", "title": "Στελέχωση γραφείου", "document_id": "ΦΕΚ Α' 1/2026", "publication_date": "2026-01-08", "document_structure": "cabinet_act",
    "action_info": {"number": "39", "date": "2025-12-23", "title": "Στελέχωση του Γραφείου"}, "organ": "ΤΟ ΥΠΟΥΡΓΙΚΟ ΣΥΜΒΟΥΛΙΟ",
    "aitiologia": {"intro": "Έχοντας υπόψη:", "items": [{"number": 1, "intro": "Τις διατάξεις:", "subitems": [{"letter": "α", "text": "Των παρ. 1"}, {"letter": "β", "text": "Του άρθρου 90"}]}, {"number": 2, "text": "Την ανάγκη"}]},
    "decision": {"intro": "αποφασίζει:", "articles": [{"number": 1, "text": "Αυξάνονται"}, {"number": 2, "text": "Οι θέσεις"}], "publication_instruction": "Να δημοσιευθεί."},
    "signatures": {"prothypourgos": "Κ.Μ.", "members": ["Κ.Χ.", "Κ.Π.", "Γ.Γ."]}, "contact_info": {"address": "Καποδιστρίου 34", "phone": None, "url": "https://x.gr"},
}


def test_cabinet_act(spark):
    import json
    import xml.etree.ElementTree as ET

    def built(payload_):
        df = spark.createDataFrame([(json.dumps(payload_, ensure_ascii=False),)], "v string").select(F.from_json("v", render.CABINET).alias("p"))
        return df.select(render.is_cabinet(F.col("p")).alias("ok"), render.cabinet_xml(F.col("p")).alias("x")).first()

    ok, x = built(ACT)
    root = ET.fromstring(x)
    assert ok and root.tag == "EfimeridaKyverniseos" and root.find("Metadata/ArithmosFyllou").text == "2026"
    praxi = root.find("Periexomena/Kefalaio/Praxi")
    assert praxi.attrib == {"arithmos": "39", "hmerominia": "2025-12-23"}
    assert [e.attrib["arithmos"] for e in praxi.findall("AitiolologikoMeros/Stoicheio")] == ["1", "2"]
    assert [e.text for e in praxi.iter("Peripton")] == ["Των παρ. 1", "Του άρθρου 90"] and [e.text for e in praxi.iter("Melos")] == ["Κ.Χ.", "Κ.Π.", "Γ.Γ."]
    assert [e.text for e in praxi.iter("Keimeno")] == ["Αυξάνονται", "Οι θέσεις"] and praxi.find("Ypografes/Prothypourgos/Onoma").text == "Κ.Μ."
    assert [e.tag for e in root.find("Epikoinonia")] == ["Dieuthinsi", "HlektronikaDieuthinsi"]
    ok, x = built({"title": "t", "document_structure": "cabinet_act", "action_info": {}, "aitiologia": {}, "decision": {}, "signatures": {}, "contact_info": {}})
    assert not ok and [e.tag for e in ET.fromstring(x).find("Periexomena/Kefalaio/Praxi")] == ["Titlos", "Organ"]


def test_gazette_title_without_accents(spark):
    none = F.array().cast("array<struct<kind:string,text:string>>")
    for title, want in (("ΠΡΑΞΗ 3", True), ("Πράξη 3", True), ("νόμος", False), (None, False)):
        assert one(spark, title, lambda c: render.gate(F.lit("law"), c, F.lit(None).cast("string"), none)) is want


@pytest.mark.parametrize("raw, error", [("x", payload.NO_OBJECT), (None, payload.NO_OBJECT), ('{"s": [{"a": 1}, {"b": "x, y', "LLM returned non-JSON output: "), ('{"a": 1}', None)])
def test_reply_errors(raw, error):
    try:
        assert payload.read_object(raw) == {"a": 1} and error is None
    except ValueError as e:
        assert str(e).startswith(error)


def test_normalise_takes_anything(spark):
    kinds = '{"sections": [{"kind": "ref"}, {}, 3], "date": "null", "title": null}'
    df = spark.createDataFrame([("[1]",), ("{bad",), (None,), (kinds,)], "v string")
    got = [r.m for r in df.select(payload.normalise(F.col("v")).alias("m")).collect()]
    assert got[:3] == [None, None, None] and got[3]["title"] is None and got[3]["publication_date"] == "null"
    assert got[3]["sections"] == '[{"kind": "citation"}, {"kind": "paragraph"}, 3]'


def test_html_of_null_id(spark):
    none = F.lit(None).cast("string")
    page = render.html(none, none, none, none, F.array().cast("array<struct<kind:string,text:string>>"), F.array().cast("array<string>"))
    assert "<p><strong>ID:</strong> </p>\n<p><strong>Type:</strong> unknown</p>" in spark.range(1).select(page.alias("o")).first()["o"]


def test_unseen_heads_of_any_length(spark):
    items = spark.createDataFrame([(1, "short item"), (2, "x" * 60), (3, ""), (4, None), (5, "absent"), (6, "y" * 50 + "tail")], "k int, t string")
    pages_ = spark.createDataFrame([("a short item here",), ("x" * 49,), (None,), ("z" + "y" * 50,)], "page string")
    assert sorted(r.k for r in pages.unseen(items, pages_, "t", "page").collect()) == [2, 5]
    assert pages.unseen(items, pages_.limit(0), "t", "page").count() == 6


def test_fallback_tries_models_and_profiles_in_order():
    asked, said = [], []

    def call(model, prompt, options):
        asked.append((model, options["num_ctx"]))
        if model == "b" and options["num_ctx"] == 2048:
            return {"message": {"content": "yes"}}
        raise OSError("down")

    got = models.fallback(["a", "b"], call, log=lambda s, m: said.append(m))("p")
    assert got == models.Reply("b", True, "used b(cpu_safe)", "yes") and asked == [("a", 4096), ("a", 2048), ("b", 4096), ("b", 2048)] and len(said) == 7
    with pytest.raises(RuntimeError, match="failed: a$"):
        models.fallback(["a"], call)("p")
    assert models.names_of({"models": [{"name": "x"}, {"model": ""}, {"model": "y"}]}) == ["x", "y"] and models.content_of(object()) == "{}"


def test_settings(spark):
    from folioflow.sources import outputs

    spark.conf.set("spark.folioflow.auto_start", "FALSE")
    got = outputs.settings(spark)
    assert got["auto_start"] is False and got["num_ctx"] == 4096 and got["converter.endpoint"] is None
    spark.conf.unset("spark.folioflow.auto_start")


def test_clients_that_fail_are_evicted(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(k,)], "v int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen, calls = [], []

    def bad(batch, number):
        calls.append(number)
        raise OSError("gone")

    clients = {"good": lambda b, n: seen.extend(r.v for r in b.collect()), "bad": bad}
    stream = spark.readStream.schema("v int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ev.broadcast(stream, clients, str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(seen) == [0, 1, 2] and len(calls) == 1 and list(clients) == ["good"]


def test_images_and_versions_are_written(spark, tmp_path):
    from folioflow.sources import outputs

    got = src.images(spark.createDataFrame([("f", b"ok")], "path string, content binary"), lambda b: [(1, 5, "png", b"x"), (2, 5, "png", b"x")])
    outputs.write_images(got, str(tmp_path / "img"))
    assert got.count() == 2 and spark.read.parquet(str(tmp_path / "img")).count() == 1
    change = spark.createDataFrame([("l", "new", "old", None, 1)], "law string, new string, old string, date string, seq int")
    rows = amend.snapshot(change, "law", "seq", "old", "new", "date").collect()
    assert {r.kind for r in rows} == {"version", "current", "previous"} and all(r.date_label == "" or len(r.date_label) == 10 for r in rows)


def test_paths(spark):
    assert [one(spark, v, lambda c: T.relative(c, "/data")) for v in ("/data/a/b.png", "/other/x")] == ["a/b.png", "/other/x"]
    assert [one(spark, v, T.extension) for v in ("/a.b/c.PDF", "/a.b/c", ".x")] == ["pdf", "", ""]


def test_output_lookup(spark):
    kept = spark.createDataFrame([("a", "<x/>"), ("b", "<y/>")], "id string, text string")
    assert [[r.text for r in src.output(kept, n, ".html").collect()] for n in ("a.html", "a.xml", "c.html")] == [["<x/>"], [], []]


@given(st.lists(st.tuples(st.sampled_from(["replace", "insert", "delete", "odd", None, "DELETE"]), st.sampled_from(["", "a", " b ", "zz", None]), st.sampled_from(["", "ab", "b\n", None]), st.sampled_from([0.9, 0.74999, 0.0])), max_size=6))
@settings(max_examples=15, deadline=None)
def test_streamed_fold_equals_the_expression(spark, steps):
    rows = [(i, 1, *x) for i, x in enumerate(steps)] or [(0, 1, "insert", "", "x", 0.9)]
    df = spark.createDataFrame(rows, "i int, law int, operation string, old_text string, new_text string, confidence double")
    laws = spark.createDataFrame([(1, "a b a"), (2, "x")], "law int, current_text string")
    got = amend.fold_laws(df, "law", ["i"], laws).collect()
    am = F.array_sort(F.collect_list(F.struct("i", "operation", "old_text", "new_text", "confidence")))
    want = df.groupBy("law").agg(am.alias("am")).select(amend.apply_amendments(F.lit("a b a"), F.col("am")).alias("r")).select("r.*").collect()
    assert [tuple(r)[1:] for r in got] == [tuple(r) for r in want]
