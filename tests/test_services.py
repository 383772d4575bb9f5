"""Sources behind services and calls of models, against stand-ins."""

import json
import re

import feeds
import pytest
from pyspark.sql import functions as F

from quern.plans import model_calls
from quern.sources import chat, wiki
from quern.streaming import events


@pytest.fixture
def pages(spark):
    spark.dataSource.register(wiki.WikiSource)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    feeds.forget()
    yield spark.read.format("wiki").option("api", "feeds:wiki").option("space", "S").option("limit", "5").option("pages", "6").option("run", "2").load()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_all_pages_of_a_wiki(pages):
    got = pages.collect()
    assert sorted(int(r["id"]) for r in got) == list(range(23)) and {r["space"] for r in got} == {"S"}
    # three tasks: pages of results 0 and 1, 2 and 3, and 4, which isn't full
    assert len(feeds.asked()) == 5


def test_since_is_pushed_to_the_wiki(pages):
    late = pages.where(F.col("updated_at") >= F.lit("2024-01-01 00:19:31").cast("timestamp"))
    plan = late._jdf.queryExecution().executedPlan().toString()
    # Spark compares no times any more: that is left to the source
    assert "BatchScan" in plan and not re.search(r"updated_at#\d+ >=", plan)
    # page 19 changed in that minute, but a second before
    assert sorted(int(r["id"]) for r in late.collect()) == [20, 21, 22]
    assert {a for a in feeds.asked()} == {"search 2024-01-01 00:19 0", "search 2024-01-01 00:19 10", "search 2024-01-01 00:19 20"}


def test_one_page_is_fetched_alone(pages):
    got = pages.where("id = '7' AND title LIKE 'T%'").collect()
    assert [(r["id"], r["html"], r["version"]) for r in got] == [("7", "<p>page 7</p>", 8)] and feeds.asked() == ["one 7"]
    assert pages.where("id = '99'").count() == 0


def test_paths_of_pages(spark, pages):
    got = {r["id"]: r["path"] for r in wiki.page_paths(pages).collect()}
    assert got["22"] == "T1 / T2 / T5 / T11 / T22" and got["0"] == "T0" and len(got) == 23
    odd = spark.createDataFrame([("a", "A", "b"), ("b", "B", "a"), ("c", "C", "gone"), ("d", None, "c")], "id string, title string, parent_id string")
    assert {r["id"]: r["path"] for r in wiki.page_paths(odd).collect()} == {"c": "C", "d": "C / "}
    docs = wiki.wiki_documents(pages).where("page_id = '5'").collect()
    assert (docs[0]["source_id"], docs[0]["path"], docs[0]["content_type"]) == ("wiki_5", "T1 / T2 / T5", "html")


def test_chat_reads_no_message_twice(spark, tmp_path):
    spark.dataSource.register(chat.ChatSource)

    def say(*rows, mode="a"):
        with open(feeds.chat.path, mode) as f:
            for channel, ts, thread, user, text in rows:
                f.write(json.dumps({"channel": channel, "ts": ts, "thread_ts": thread, "user": user, "text": text}) + "\n")

    def read():
        rows = spark.readStream.format("chat").option("api", "feeds:chat").option("channels", "#ops,dev").load()
        return chat.growing_threads(rows)

    def sync():
        events.run_once(read(), f"{tmp_path}/threads", f"{tmp_path}/checkpoint", "update")
        return {(r["channel"], r["thread_ts"]): (r["n"], r["participants"], r["text"]) for r in chat.latest_threads(spark, f"{tmp_path}/threads").collect()}

    say(("ops", "10.000001", None, "ann", "down?"), ("ops", "11.5", "10.000001", "bob", "yes"), ("ops", "12.5", None, None, "other"), ("dev", "9.0", None, "cy", "hi"), mode="w")
    first = sync()
    assert first["ops", "10.000001"] == (2, ["ann", "bob"], "[10.000001] ann: down?\n[11.5] bob: yes")
    assert first["ops", "12.5"] == (1, [], "[12.5] unknown: other") and first["dev", "9.0"][0] == 1
    feeds.forget()
    say(("ops", "13.000000", "10.000001", "ann", "fixed"))
    again = sync()
    # the thread has grown by one line, and the other channel isn't read again
    assert again["ops", "10.000001"] == (3, ["ann", "bob"], "[10.000001] ann: down?\n[11.5] bob: yes\n[13.000000] ann: fixed")
    assert {k: v for k, v in again.items() if k != ("ops", "10.000001")} == {k: v for k, v in first.items() if k != ("ops", "10.000001")}
    assert {a.split()[1] for a in feeds.asked()} == {"ops"}


def test_calls_stay_within_both_bounds(spark):
    texts = [(k, "x" * (k * 7 % 50), ) for k in range(120)] + [(200, None), (201, " \n "), (202, "a\nb " + "y" * 40_000)]
    calls = list(model_calls.packed(iter(texts), 10, 60))
    assert [key for c in calls for key, _ in c] == [k for k, _ in texts]
    for c in calls:
        tokens = sum(len(t) // 4 + 1 for _, t in c)
        assert len(c) <= 10 and (tokens <= 60 or len(c) == 1)
    # no call could have taken the next one's first text
    for a, b in zip(calls, calls[1:], strict=False):
        assert len(a) == 10 or sum(len(t) // 4 + 1 for _, t in [*a, b[0]]) > 60
    sent = {k: t for c in calls for k, t in c}
    assert sent[200] == " " and sent[201] == " " and len(sent[202]) == 32_000 and sent[202].startswith("a b y")

    def load():
        def model(batch):
            return [[len(batch), len(t)] for t in batch]

        return model

    rows = spark.createDataFrame([(str(k), t) for k, t in texts], "node_id string, text string").coalesce(1)
    got = {r["node_id"]: r["v"] for r in model_calls.embedded(rows, load, 50, 10**6).collect()}
    assert len(got) == 123 and got["0"][0] == 50.0 and got["201"] == [23.0, 1.0] and got["202"][1] == 32_000.0
    assert model_calls.embedded(rows.limit(0), load).count() == 0


def test_summaries_are_asked_for_again(spark):
    body = " ".join(f"word{k}" for k in range(60))
    rows = spark.createDataFrame([(1, 0, body), (2, 1, body), (3, 2, body), (4, 3, body), (5, 0, "mute " + body), (6, 0, None), (7, 1, "fine text")], "node_id long, layer int, text string")

    def ask(text, mode, purpose, words):
        said = {"write": F.when(F.startswith(text, F.lit("mute")), None).when(text == "fine text", F.lit("good")).otherwise(text), "shorten": F.lit("").cast("string"), "reword": F.concat(mode, F.lit(" in other words")), "bullets": F.concat(F.lit("- one\n- two"))}[purpose]
        return F.struct(said.alias("text"), (F.lit(purpose == "write") & (F.length(text) > 100)).alias("cut"))

    got = {r["node_id"]: (r["mode"], r["summary"], r["asked"]) for r in model_calls.summarised(rows, ask, {1: "summary", 2: "bullets", 3: "keywords"}, max_tokens=4).collect()}
    assert got[1] == ("details", "details in other words", 3) and got[2] == ("summary", "summary in other words", 3)
    assert got[3] == ("bullets", "- one\n- two", 4)  # cut off, copied, then without bullets
    assert got[4] == ("keywords", body, 2)  # keywords may copy; an empty second answer changes nothing
    assert got[5] == ("details", "mute word0 word1 word2", 1) and got[6] == ("details", " ", 1) and got[7] == ("summary", "good", 1)
    with pytest.raises(ValueError, match="unknown mode"):
        model_calls.summarised(rows, ask, {1: "poem"})
    assert model_calls.asked_words(10) == 25 and model_calls.asked_words(500) == 350
    assert "bullet" in model_calls.instruction("bullets", "bullets", 10) and "60 words" in model_calls.instruction("write", "summary", 60)


@pytest.mark.parametrize(("summary", "copied"), [("# A heading", True), ("See Source: x", True), ("short", False), (" ".join(f"w{k}" for k in range(30)), True), (" ".join(f"v{k}" for k in range(30)), False)])
def test_copies(spark, summary, copied):
    context = " ".join(f"w{k}" for k in range(40))
    assert spark.range(1).select(model_calls.looks_copied(F.lit(summary), F.lit(context))).first()[0] == copied


def test_sample_rows(spark):
    from quern.sources import readers

    assert {r["doc_id"]: len(r["content"]) for r in readers.sample_rows(spark).collect()} == {"sample_1": 49, "sample_2": 42, "sample_3": 50}


def test_fallbacks_of_incidents(spark):
    from quern.plans import strategies

    q = spark.createDataFrame([(1, "High LATENCY in checkout"), (2, "nothing")], "query_id long, text string")
    books = spark.createDataFrame([(10, ["high latency", "checkout fails", "slow disk"]), (11, ["disk"]), (12, None)], "node_id long, symptoms array<string>")
    assert {tuple(r) for r in strategies.runbooks_by_symptoms(q, books).collect()} == {(1, 10, 0.6)}
    told = spark.createDataFrame([(20, "High latency", "in the shop", "resolved"), (21, "high latency", None, "open"), (22, "latency", None, "resolved")], "node_id long, name string, description string, status string")
    assert {tuple(r) for r in strategies.incidents_by_words(q, told).collect()} == {(1, 20, 0.6)}
