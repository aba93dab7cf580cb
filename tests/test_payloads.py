import datetime as dt
import io
import json
import zipfile

from hypothesis import given, settings
from hypothesis import strategies as st

from answerscope.functions import brands as B
from answerscope.sources import exports, imports, payloads


def event(x):
    return "event: delta\ndata: " + json.dumps(x) + "\n\n"


def sample():
    m = {"v": {"message": {"id": "m1", "author": {"role": "assistant", "metadata": {}}, "content": {"content_type": "text", "parts": ["**Acme** is"]}, "metadata": {"model_slug": "x"}}, "conversation_id": "c"}, "channel": "final"}
    src = {"v": [{"type": "search_result", "url": "https://www.acme.com/a?utm_source=x", "title": "T", "ref_id": {"turn_index": 0, "ref_type": "search", "ref_index": 1}}, {"url": "https://www.acme.com/a", "attribution": "Acme"}]}
    body = {"messages": [{"author": {"role": "user"}, "content": {"parts": ["best  tools", "best  tools"]}}]}
    raw = event(m) + event({"p": payloads.CONTENT, "o": "append", "v": " good. "}) + event({"v": "Globex too."}) + event({"search_model_queries": {"queries": ["q1", "q1", "q2"]}}) + event({"type": "title_generation", "title": "One"}) + event({"type": "title_generation", "title": "Two"}) + event(src) + "data: [DONE]\ndata: {broken\n"
    return raw, json.dumps(body)


def test_sse_record():
    r = payloads.derive_sse(*sample(), tracked=[{"name": "Globex", "relation": "own"}])
    assert r["answer_text"] == "**Acme** is good. Globex too." and r["user_prompt"] == "best  tools" and r["generated_title"] == "Two"
    assert [(s["url"], s["outcome"], s["marker_ids"]) for s in r["sources"]] == [("https://www.acme.com/a", "cited", ["turn0search1"])]
    assert r["fanout"]["search"] == [{"query": "q1"}, {"query": "q2"}]
    assert [(b["brand"], b["count"], b["relation"]) for b in r["brand_mentions"]] == [("Acme", 1, None), ("Globex", 1, "own")]


def test_rpc_record():
    answer = "1. **Acme** Phones\n" + "words " * 40
    inner = [["https://acme.com/x", "Title", "https://t0.gstatic.com/f", " Snip ", None, None, "Acme"], answer]
    raw = ")]}'\n\n123\n" + json.dumps([["wrb.fr", None, json.dumps(inner)]]) + "\n9\n" + json.dumps([["wrb.fr", None, "[1]"], ["di", 5]])
    r = payloads.derive_rpc(raw, "f.req=%5Bnull%2C%22%5B%5B%5C%22best%20phone%5C%22%2C0")
    assert r["user_prompt"] == "best phone" and r["sources"][0]["snippet"] == "Snip" and r["answer_text"] == answer and r["searched"]


def test_derive_keeps_bad_rows(spark):
    raw, body = sample()
    now = dt.datetime(2024, 1, 1)
    rows = [("a", "chatgpt", "https://chatgpt.com/backend-api/conversation", body, None, None, now, raw, None, 1), ("b", "chatgpt", "https://chatgpt.com/backend-api/f/conversation?x", "{", None, None, now, "data: 1\n", None, 1), ("c", "gemini", "https://x/StreamGenerate", None, None, None, now, "short", None, 1), ("d", "x", "https://other/", None, None, None, now, "x", None, 1)]
    from answerscope.schema import RAW

    usable, skipped = payloads.landing(spark.createDataFrame(rows, RAW))
    assert [r["reason"] for r in skipped.collect()] == ["too-small"]
    got = {r["capture_id"]: r for r in payloads.derive(usable).collect()}
    assert set(got) == {"a", "b"} and got["a"]["error"] is None and got["a"]["brand_mentions"][0]["brand"] == "Acme" and got["b"]["answer_text"] == ""
    assert got["a"]["reference_types"] == {"search": 1} and "Acme" in exports.documents(payloads.derive(usable).where("capture_id = 'a'")).first()["html"]


def test_model_labels():
    assert payloads.rpc_model([None] * 42 + ["3 Pro"]) == "Gemini 3 Pro" and payloads.rpc_model([["x", "3.5 Flash"]]) == "Gemini 3.5 Flash" and payloads.rpc_model([]) == "gemini"


def test_lines_end_with_line_feeds_only():
    """Other separators are legal inside JSON; indented data lines count."""
    node = {"v": "a\u2028b\u0085c\x0bd"}
    raw = "data: " + json.dumps(node, ensure_ascii=False).replace("\\u000b", "\x0b").replace("\x0b", "") + "\r\n  data: [1]\r\ndata:\ndata: {broken\ndata: [DONE]"
    assert payloads.sse_nodes(raw) == [{"v": "a\u2028b\u0085cd"}, [1]]
    inner = json.dumps(json.dumps(["x\u2028y"], ensure_ascii=False), ensure_ascii=False)
    assert payloads.rpc_payloads(f")]}}'\n\n12\n[[\"wrb.fr\", null, {inner}]]\nnonsense") == [["x\u2028y"]]


def test_images_and_values_by_key():
    nodes = [{"a": [{"image_url": "https://i/1", "title": "One"}, {"image_url": "https://i/2"}, {"image_url": "https://i/1", "source": "S"}]}]
    assert payloads.sse_images(nodes, [{"image": "https://i/2"}]) == [{"url": "https://i/1", "title": "One", "attribution": "S"}]
    assert payloads.collect_by_key(nodes, "^image", lambda v: v.endswith("1")) == ["https://i/1", "https://i/1"]
    assert payloads.rpc_answer([["x" * 200], "- " + "I have successfully done it. " * 20, "## " + "words " * 40]) == "## " + "words " * 40


def test_reference_types_ignore_the_turn():
    assert payloads.reference_types([], "turn0search2 turn1search2 turn0news1") == {"search": 1, "news": 1}


def test_longest_name_first():
    got = {b["brand"]: b["count"] for b in B.detect("Tata Motors leads. Tata is large.", tracked=[{"name": "Tata"}, {"name": "Tata Motors"}]).brands}
    assert got == {"Tata Motors": 1, "Tata": 1}


def test_tables_and_domains():
    assert B.table_cells("| Brand | Price |\n|---|:--:|\n| **Acme** | 1 |\n| Bolt \\| Co | 2 |\n\nx") == ["**Acme**", "Bolt | Co"]
    assert [B.brand_of_domain(d) for d in ("northwind.com", "shop.contoso.org", "fabrikam.com.au", "tailspin.club", "x.com", None)] == ["Northwind", "Contoso", "Fabrikam", "Tailspin", None, None]
    assert B.label_spans("We like Angel One and AngelOne.", "angelone") == [(8, 17), (22, 30)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=B.OPEN + B.MID + B.CLOSE + "citeurn0s1 ab[]\",", max_size=60))
def test_segments_are_lossless(text):
    assert "".join(s["value"] for s in B.segments(text)) == text


def test_footnotes_number_by_url():
    c = B.OPEN + "cite" + B.MID + "turn0search1" + B.CLOSE
    out = exports.footnotes(f"A {c} B {c}{B.OPEN}cite{B.MID}turn9x9{B.CLOSE}", [{"url": "u", "marker_ids": ["turn0search1"]}, {"url": "v", "marker_ids": []}])
    assert out == {"text": "A [1] B [1]", "notes": ["u"], "unresolved": ["turn9x9"], "others": ["v"]}


def test_extractor_never_costs_the_record():
    base = B.detect("Acme Phone is fine", tracked=[{"name": "Acme"}]).brands
    assert B.merge_extracted(base, "Acme Phone is fine", lambda t: 1 / 0) == base
    assert [b["brand"] for b in B.merge_extracted(base, "Acme Phone is fine", ["Acme Phone", "Nowhere"])] == ["Acme Phone"]


def workbook(method):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>S.No</t></si><si><r><t>Pro</t></r><r><t>mpt</t></r></si><si><t>Industry</t></si><si><t>under &#8377;50 &amp; up</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>2</v></c><c r="D1" t="s"><v>1</v></c></row><row><c r="A2"><v>1</v></c><c r="B2" t="inlineStr"><is><t>Phones; 5G</t></is></c><c r="D2" t="s"><v>3</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_imports(spark, tmp_path):
    for method in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        assert imports.rows_to_prompts(imports.parse_workbook(workbook(method))) == [{"text": "under ₹50 & up", "tags": ["Phones", "5G"]}]
    (tmp_path / "a.xlsx").write_bytes(workbook(zipfile.ZIP_DEFLATED))
    assert imports.read_workbooks(spark, str(tmp_path)).first()["tags"] == ["Phones", "5G"]
    assert imports.parse_delimited('a,"b, ""c"""\r\n\r\n"x\ny",\n') == [["a", 'b, "c"'], ["x\ny", ""]]
    assert imports.rows_to_prompts([["one", "t1|t2"], ["", "x"], ["two"]]) == [{"text": "one", "tags": ["t1", "t2"]}, {"text": "two", "tags": []}]
    assert imports.parse_lines("one, a, b\n\ntwo") == [{"text": "one", "tags": ["a", "b"]}, {"text": "two", "tags": []}]


def test_capture_file_round_trip():
    got = payloads.read_capture("# capture 1\n# url: u\n# reqBody: {}\n\ndata: 1\n")
    assert got["url"] == "u" and got["req_body"] == "{}" and payloads.sse_nodes(got["raw"]) == [1]


def test_fixed_decimals():
    assert exports.to_fixed(1.005, 2) == "1.00" and exports.to_fixed(2.5, 0) == "3"


def test_places_of_an_rpc_payload():
    v = [None] * 40
    v[0], v[13], v[30], v[31] = "places/abc", 4.5, ["Cafe One"], ["Coffee shop"]
    v[1], v[2], v[3], v[4], v[5], v[6], v[7] = "+91 98765 43210", "12th Main Road, Indiranagar", "https://cafe.example/", "https://maps.google.com/?q=x", [12.5, 77.25], " · ₹200-₹400", ["Monday: 10 AM", "Tuesday: 10 AM", "Wednesday: x", "Thursday: x", "Friday: x"]
    v[2] = "Main Road, Indiranagar, Bengaluru"
    got = payloads.rpc_places([1, [v, v], ["places/no"]])
    assert got == [{"place_id": "abc", "name": "Cafe One", "category": "Coffee shop", "rating": 4.5, "phone": "+91 98765 43210", "address": "Main Road, Indiranagar, Bengaluru", "website": "https://cafe.example/", "maps_url": "https://maps.google.com/?q=x", "lat": 12.5, "lng": 77.25, "price_range": "₹200-₹400", "hours": "Monday: 10 AM, Tuesday: 10 AM, Wednesday: x, Thursday: x, Friday: x"}]
    raw = json.dumps([["wrb.fr", None, json.dumps([v, "x"])]])
    r = payloads.derive_rpc(raw, None)
    assert r["turn_use_case"] == "local" and r["carousels"]["map"] and r["places"] == got and r["brand_mentions"] == [] or r["brand_mentions"][0]["brand"] == "Cafe One"


def test_product_markers_and_vendors():
    o, m, c = B.OPEN, B.MID, B.CLOSE
    text = f'{o}products{m}{{"selections":[["turn0product1","Sony WH-1000"],["turn0product2",7],"no",["turn0product3","\\"Bose\\" QC"]]}}{c} and {o}product{m}["turn0product4","[Acme] Zed",{{}}]{c}'
    assert [(b["brand"], b["count"]) for b in B.detect(text).brands] == [("Sony", 0), ("Bose", 0), ("Acme", 0)]
    assert B.vendor("(JBL) Flip") == "JBL" and B.vendor("3M tape") is None and B.clean_candidate("x" * 41) == "" and B.clean_candidate("🥇 Best: iQOO — 10") == "Best: iQOO"
