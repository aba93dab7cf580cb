import datetime as dt

from answerscope.api import PROMPTS, Engine
from answerscope.functions import analysis
from answerscope.operators.metrics import Brand, brand_metrics

from .test_payloads import sample


def test_commands(spark, tmp_path):
    from answerscope.schema import RAW

    e = Engine(spark, str(tmp_path))
    e.handle("settings-set", my_brand="Globex")
    raw, body = sample()
    geo = ("p1", "r1", "q1", ["t"])
    rows = [("a", None, "https://chatgpt.com/backend-api/conversation", body, None, None, dt.datetime(2024, 1, 1), raw, geo, 1), ("b", None, "https://chatgpt.com/backend-api/conversation", body, None, None, dt.datetime(2024, 1, 2), raw, None, 1)]
    assert e.handle("raw-conversation", rows=spark.createDataFrame(rows, RAW))["ok"]
    assert e.handle("stats")["result"] == {"raw": 2, "derived": 2}
    got = e.handle("metrics", brands=[Brand("Globex", "", True), Brand("Acme", "acme.com"), Brand("None", "")], profile_id="p1")["result"]
    table = {r["name"]: r for r in got["brands"].collect()}
    assert (table["Acme"]["total"], table["Acme"]["visibility"], table["Acme"]["share_of_voice"], table["Acme"]["citations"]) == (1, 100.0, 50.0, 1)
    assert table["Globex"]["avg_position"] == 2 and table["None"]["responses_present"] == 0 and table["None"]["avg_position"] is None
    assert not e.handle("nonsense")["ok"] and not e.handle("run-start", profile_id="zz")["ok"]
    e.handle("profile-save", id="p1", name="P", brand={"name": "Globex"}, engines=["chatgpt", "grok"])
    new = spark.createDataFrame([("1", "p1", " One  ", [" a ", "a", ""], None, 1), ("2", "p1", "one", [], True, 2), ("3", "p1", "two", ["b"], True, 3)], PROMPTS)
    assert e.handle("prompt-bulk-add", rows=new)["result"] == {"added": 2, "duplicate": 1}
    assert e.handle("run-start", profile_id="p1")["result"]["expected"] == 2
    e.handle("tag-rename", old="a", new="b")
    assert [r["tag"] for r in e.handle("tag-list")["result"].collect()] == ["b"]
    for k in range(2):
        e.handle("profile-save", id=f"x{k}", name="X", brand={})
    assert "at most" in e.handle("profile-save", id="x9", name="X", brand={})["error"]
    e.handle("profile-trash", key="x0", now_ms=0)
    assert [p.id for p in e.handle("profile-list", now_ms=8 * 86_400_000)["result"]] == ["p1", "x1"] and "x0" not in e.profiles.rows
    assert e.handle("settings-set", retention_max=1, max_capture_mb=0)["result"].retention_max == 50
    assert e.handle("reprocess-all")["ok"] and e.handle("delete-record", keys=e.raw.get("a"))["ok"] and e.handle("stats")["result"] == {"raw": 1, "derived": 1}


def test_metric_examples(spark):
    """Published examples: 45 of 100 responses; 4 against 12 mentions; a shown brand; a swap of places."""
    schema = "capture_id string, platform string, brand_mentions array<struct<brand:string,count:bigint,first_index:bigint>>, sources array<struct<domain:string,outcome:string,url:string>>, answer_text string"
    own = [Brand("Own", "own.com", True), Brand("Rival", "rival.com")]
    run = lambda rows: {r["name"]: r for r in brand_metrics(spark.createDataFrame([(str(k), "x", m, s, t) for k, (m, s, t) in enumerate(rows)], schema), own).collect()}
    assert run([([("Own", 1, 0)] if k < 45 else [], [], "") for k in range(100)])["Own"]["visibility"] == 45
    got = run([([("own", 4, 0), ("RIVAL", 12, 9)], [], "")])
    assert (got["Own"]["share_of_voice"], got["Rival"]["share_of_voice"]) == (25, 75)
    shown = run([([("Own", 0, (1 << 53) - 1)], [], "")])["Own"]
    assert (shown["visibility"], shown["mentions"], shown["avg_position"]) == (100, 0, None)
    swap = run([([("Own", 1, 0), ("Rival", 1, 5)], [], ""), ([("Own", 1, 7), ("Rival", 1, 5)], [], "")])
    assert swap["Own"]["avg_position"] == swap["Rival"]["avg_position"] == 1.5
    src = run([([], [("own.com", "cited", "u")], ""), ([], [("a.own.com", "fetched", "u")], ""), ([], [("notown.com", "cited", "u")], "")])["Own"]
    assert (src["citations"], src["source_responses"], round(src["source_visibility"], 2)) == (1, 2, 66.67)
    text = run([([], [], "The owner and own goals, then Own wins")])
    assert text["Own"]["avg_position"] == 1 and text["Rival"]["responses_present"] == 0
    assert run([([], [], "own goals, owner")])["Own"]["responses_present"] == 0


def test_record_analysis():
    text = "1. **Acme** Nord 5G is best for daily use. Its price is fair.\n2. Globex leads"
    assert analysis.models("Acme", [{"name": "Acme Zed 9"}], text) == ["Zed 9", "Nord 5G"]
    assert analysis.list_rank("Globex", text) == 2 and analysis.list_rank("Nobody", text) is None
    assert analysis.list_place("Acme", "## 2. **Acme Zed** (Best for travel)\n") == (2, "Best for travel") and analysis.list_place("Bolt", "3) Bolt – small: cheap") == (3, "small: cheap") and analysis.list_place("Acme", text)[0] == 1
    assert analysis.aspects([text]) == ["Daily use", "Price & Value"]
    assert analysis.aspects(["It is known for its camera quality and it stands out for long trips. Great for you."]) == ["Camera quality", "Long trips", "Quality"] and analysis.aspects([]) == []
    assert analysis.models("Acme", [], "Acme The One. Acme Nord 5G, Acme is. Acme Pro (max)!") == ["Nord 5G", "Pro"]
    rec = {"sources": [{"title": "Globex G7 tested", "snippet": "Acme Mini 3, and more"}]}
    assert analysis.is_hero("Acme Zed", "the acme zed 9") and not analysis.is_hero("Acme Zed", "Globex") and analysis.product_sources("Acme Zed", rec["sources"]) == [0]
