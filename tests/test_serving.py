import io
import json
import logging
import urllib.error
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quillspan import logs, snapshot_tool
from quillspan.operators import generation as g
from quillspan.operators import session as ses
from quillspan.operators import snapshots as sn
from quillspan.operators import wire
from quillspan.operators.completion import best_completions
from quillspan.operators.errors import ContextualConfigurationError, ContextualServiceError, InvalidResponseError, TranslationError

HIT = ses.Completion("  A match", "a.txt", 3, 10)


def fake_search(results=(HIT,)):
    asked = []

    def search(q):
        asked.append(q)
        return list(results)

    return search, asked


class FakeGenerator:
    def __init__(self, error=None):
        self.error, self.asked = error, []

    def generate(self, prefix, context, count=5):
        self.asked.append((prefix, context, count))
        if self.error:
            raise self.error
        return g.Generated((g.Suggestion(f"{prefix} more", "m"),), "m", 7)


class FakeTranslator:
    def translate_to_english(self, text):
        if text == "bad":
            raise TranslationError("down")
        return g.Translation(text, f"en {text}", "he")


# snapshots


def test_publish_list_rollback(spark, archive, tmp_path, capsys):
    where = str(tmp_path / "snaps")
    one, two = archive({"a.txt": "first corpus"}, "1.zip"), archive({"a.txt": "second corpus\nmore"}, "2.zip")
    assert sn.list_snapshot_versions(where) == [] and sn.get_current_version(where) is None
    v1 = sn.build_snapshot(spark, one, where, "v1")
    assert sn.get_current_version(where) is None and sn.build_snapshot(spark, "/no.zip", where, "v1") == v1
    sn.set_current_version(where, "v1")
    assert snapshot_tool.main(["--zip", two, "--snapshots-dir", where], spark) == 0
    v2 = sn.get_current_version(where)
    assert v2 != "v1" and sn.list_snapshot_versions(where) == sorted([v1, v2])
    assert sn.load_snapshot(spark, where, "v1").sentences.count() == 1
    capsys.readouterr()
    assert snapshot_tool.main(["--list", "--snapshots-dir", where]) == 0
    assert f"{v2} (current)\n" in capsys.readouterr().out
    assert snapshot_tool.main(["--rollback", "v1", "--snapshots-dir", where]) == 0 and sn.get_current_version(where) == "v1"
    assert snapshot_tool.main(["--rollback", "nope", "--snapshots-dir", where]) == 1
    with pytest.raises(FileNotFoundError):
        sn.set_current_version(where, "nope")


def test_snapshots_on_another_file_system(spark, archive, tmp_path, monkeypatch):
    """The same steps through Hadoop's file systems."""
    from quillspan import storage

    monkeypatch.setattr(storage, "remote", lambda path: path.startswith("file:"))
    where = f"file://{tmp_path}/far/snaps"
    assert sn.list_snapshot_versions(where) == [] and sn.get_current_version(where) is None
    for v in ("v1", "v2"):
        sn.build_snapshot(spark, archive({"a.txt": f"{v} line"}, f"{v}.zip"), where, v, posting_tables=False)
        sn.set_current_version(where, v)
        assert sn.get_current_version(where) == v and sn.HotReloadableIndex(spark, where).sentences().first()["original_text"] == f"{v} line"
    assert sn.list_snapshot_versions(where) == ["v1", "v2"] and not storage.move_folder(f"{where}/v1", f"{where}/v2")
    sn.set_current_version(where, "v1")
    assert sn.get_current_version(where) == "v1" and sorted(p.name for p in (tmp_path / "far" / "snaps").iterdir() if not p.name.endswith(".crc")) == ["CURRENT", "v1", "v2"]
    storage.remove_folder(f"{where}/v2")
    assert sn.list_snapshot_versions(where) == ["v1"]
    with pytest.raises(FileNotFoundError):
        sn.set_current_version(where, "v2")


def test_shared_folder_must_be_named_on_a_cluster(spark):
    from quillspan import storage

    def session(master, folder=None):
        conf = SimpleNamespace(get=lambda key, default=None: folder)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="far", getConf=lambda: conf))

    with pytest.raises(RuntimeError):
        storage.shared_folder(session("spark://far:7077"))
    assert storage.shared_folder(session("spark://far:7077", "/shared")) == "/shared"
    assert storage.shared_folder(spark) == storage.shared_folder(spark)


def test_stored_tables_are_removed(spark):
    from quillspan import storage

    df = storage.stored(spark.range(3).toDF("x"))
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    assert df.count() == 3 and storage.exists(spark, path)
    kept = set(storage._written)
    storage._written.clear()
    storage._written.add(path)
    storage.clear()
    assert not storage.exists(spark, path)
    storage._written.update(kept - {path})


def test_empty_corpus_is_rejected(spark, archive, tmp_path):
    where = tmp_path / "snaps"
    path = archive({"empty.txt": "\n\n\n"})
    with pytest.raises(sn.SnapshotValidationError):
        sn.publish_snapshot(spark, path, str(where))
    assert not where.exists()
    assert snapshot_tool.main(["--zip", path, "--snapshots-dir", str(where)], spark) == 1


def test_version_of_same_bytes(archive):
    path = archive({"a.txt": "x"})
    assert sn.version_id(path)[-12:] == sn.version_id(path)[-12:] and len(sn.version_id(path)) == 29


def test_hot_reload(spark, archive, tmp_path):
    where, now = str(tmp_path / "snaps"), [0.0]
    for v, text in (("v1", "old line"), ("v2", "new line")):
        sn.build_snapshot(spark, archive({"a.txt": text}, f"{v}.zip"), where, v, posting_tables=False)
    sn.set_current_version(where, "v1")
    hot = sn.HotReloadableIndex(spark, where, 2.0, clock=lambda: now[0])
    old = hot.sentences()
    assert hot.current_version == "v1" and old.first()["original_text"] == "old line"
    sn.set_current_version(where, "v2")
    now[0] = 1.9
    assert hot.get().sentences.first()["original_text"] == "old line"
    now[0] = 2.0
    assert hot.get().sentences.first()["original_text"] == "new line" and hot.current_version == "v2"
    assert old.first()["original_text"] == "old line"
    (tmp_path / "snaps" / "broken").mkdir()
    sn.set_current_version(where, "broken")
    now[0] = 9
    assert hot.get().sentences.first()["original_text"] == "new line" and hot.current_version == "v2"
    (tmp_path / "snaps" / "CURRENT").unlink()
    now[0] = 20
    assert hot.get().sentences.first()["original_text"] == "new line"
    sn.set_current_version(where, "broken")
    with pytest.raises(Exception):  # noqa: B017
        sn.HotReloadableIndex(spark, where).get()


def test_fallback_to_archive(spark, archive, tmp_path):
    hot = sn.HotReloadableIndex(spark, str(tmp_path / "none"), zip_path=archive({"a.txt": "x y"}), cache_path=str(tmp_path / "cache"))
    assert hot.get().sentences.count() == 1 and hot.current_version is None
    with pytest.raises(FileNotFoundError):
        sn.HotReloadableIndex(spark, str(tmp_path / "none")).get()
    assert sn.default_index(spark, snapshots_dir="x") is sn.default_index(spark) is sn.default_index(spark, snapshots_dir="x")
    with pytest.raises(ValueError):
        sn.default_index(spark, snapshots_dir="y")


# sessions


def test_session_modes_and_commands():
    search, asked = fake_search()
    gen = FakeGenerator()
    s = ses.State()
    s = ses.step(s, "to ", search).state
    done = ses.step(s, "be", search)
    assert done.state.query == "to be" and asked == ["to ", "to be"]
    assert done.output == "Here are 1 suggestions:\n1. A match (a.txt:3, score=10)"
    assert ses.step(done.state, "x#", search).state == ses.State() and ses.step(done.state, "/context c#", search).output == "Query reset. Current mode: CORPUS."
    assert ses.step(done.state, " ~ ", search).should_exit and not ses.step(done.state, "a~", search).should_exit
    ai = ses.step(done.state, "/mode AI", search)
    assert ai.state == ses.State("ai") and ai.output == "Mode changed to AI. Query reset."
    ctx = ses.step(ai.state, "/context  legal text ", search)
    assert ctx.output == "AI context updated: legal text" and ses.step(ctx.state, "/context", search).output == "Current AI context: legal text"
    made = ses.step(ctx.state, "Hello", search, gen)
    assert made.output.splitlines() == ["Here are 1 AI-generated suggestion:", "Gemini model: m; response time: 7 ms; no corpus source, offset, or Part A score.", "1. [AI-GENERATED] Hello more"]
    assert gen.asked == [("Hello", "legal text", 5)]
    assert ses.step(ctx.state, "Hello", search).output == ses.NO_GENERATOR
    assert ses.step(ctx.state, "Hello", search, FakeGenerator(ContextualServiceError("late"))).output == "AI mode error: late"
    assert ses.step(s, "/context " + "x" * 501, search).output.startswith("Context is too long")
    assert ses.step(s, "/mode x", search).output == "Invalid mode. Use corpus, ai, or translation." and ses.step(s, "/what", search).output == f"Unknown command. {ses.HELP}"
    assert ses.step(s, "/help", search).output == ses.HELP and ses.step(ses.State(), "  ", search).output == ses.EMPTY_INPUT
    tr = ses.step(s, "/translate", search).state
    assert tr == ses.State("translation") and ses.step(tr, "/english", search).state == ses.State()
    assert ses.step(tr, "שלום", search, translator=FakeTranslator()).output.startswith("Translated English query: en שלום\nHere are 1")
    failed = ses.step(tr, "bad", search, translator=FakeTranslator())
    assert failed.output == "Translation failed: down" and failed.state.query == "bad"
    assert ses.step(tr, "x", search).output == "Translation mode is unavailable: no translation service configured. Your query was kept; use /english."
    assert ses.prompt(ctx.state) == "[AI | context=legal text] Enter more text: " and ses.prompt(tr) == "[TRANSLATION | target=English] Enter more text: "
    assert ses.format_results([]) == "No suggestions found."


def test_basic_session():
    search, asked = fake_search()
    assert ses.basic_step("to", "/TRANSLATE", search) == ("to", "Translation mode enabled. Target language: English.", True)
    assert ses.basic_step("to", "/english", search, translating=True) == ("to", "English mode enabled.", False)
    assert ses.basic_step("to", "x#", search) == ("", "Query reset. Start a new sentence.", False)
    assert ses.basic_step("to", " be", search)[0] == "to be" and asked == ["to be"]
    assert ses.basic_step("", " ", search)[1] == ses.EMPTY_INPUT
    assert ses.basic_step("", "x", search, FakeTranslator(), True)[1].startswith("Translated English query: en x")
    assert ses.basic_step("", "x", search, None, True)[1] == ses.NO_TRANSLATION


def test_terminal_loops():
    search, _ = fake_search()
    for loop, script in ((ses.run, ["/mode ai", "hi", "~"]), (ses.run_basic, ["to", "be~"])):
        out, lines = [], iter(script)
        loop(search, read=lambda p: next(lines), write=out.append)
        assert out[-1] == "Goodbye."

    def ended(_):
        raise EOFError

    out = []
    ses.run(search, read=ended, write=out.append)
    assert out[-1] == "\nGoodbye."


def test_shown_is_stable():
    rows = [ses.Completion(t, str(i), 0, s) for i, (t, s) in enumerate([("b", 1), ("B", 1), ("a", 1), ("z", 9), ("c", 1), ("d", 1)])]
    assert [(r.completed_sentence, r.source_text) for r in ses.shown(rows)] == [("z", "3"), ("a", "2"), ("b", "0"), ("B", "1"), ("c", "4")]


def test_accumulated_equals_machine(spark):
    inputs = ["to ", "be", "/help", " or", "#", "x", "/mode ai", "y", "/mode nope", "/context c", "z#", None, "~", "q"]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(inputs)] + [("t", 0, "own")], "sid string, seq int, text string")
    got = [r["query"] for r in ses.accumulated(df.where("sid = 's'"), "sid", ["seq"], "text").orderBy("seq").collect()]
    state, want = ses.State(), []
    for x in inputs:
        state = ses.step(state, x or "", lambda q: [], FakeGenerator()).state
        want.append(state.query)
    assert got == want
    assert {r["query"] for r in ses.accumulated(df, "sid", ["seq"], "text").where("sid = 't'").collect()} == {"own"}


def test_search_over(sentences):
    rows = sentences(["To be or not to be", "else"])
    assert ses.search_over(lambda: rows)("to be") == [ses.Completion("To be or not to be", "synthetic.txt", 0, 10)]


def test_session_stream_and_restart(spark, tmp_path):
    from quillspan.streaming.sessions import session_stream

    src, out, point = (str(tmp_path / x) for x in ("in", "out", "cp"))

    def go(rows):
        spark.createDataFrame(rows, "session_id string, seq long, text string").coalesce(1).write.mode("append").parquet(src)
        stream = session_stream(spark.readStream.schema("session_id string, seq long, text string").parquet(src))
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", point).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return {(r["session_id"], r["seq"]): r for r in spark.read.parquet(out).collect()}

    rows = go([("a", 2, " knot"), ("a", 1, "or"), ("b", 1, "/mode ai")])
    assert rows["a", 2]["query"] == "or knot" and rows["b", 1]["mode"] == "ai"
    rows = go([("a", 3, "s"), ("b", 2, "x#")])
    assert rows["a", 3]["query"] == "or knots" and rows["b", 2]["query"] == ""


def test_sessions_that_answer(spark, sentences, tmp_path):
    """Outputs of the stream are those of the machine, over two runs."""
    from quillspan.streaming.sessions import answer_stream

    class Translates:  # local, so that workers get it by value
        def translate_to_english(self, text):
            from quillspan.operators.generation import Translation

            return Translation(text, "to be", "he")

    lines = sentences(["To be or not to be", "  to bee", "to be sure", "else"])
    search = ses.search_over(lambda: lines)
    src, point, got = str(tmp_path / "in"), str(tmp_path / "cp"), {}

    def write(df, n):
        got.update({(r["session_id"], r["seq"]): (r["query"], r["output"], r["should_exit"]) for r in df.collect()})

    script = {"a": ["to ", "be", "/help", "#", "zzz", "~"], "b": ["/mode ai", "x"], "c": ["/translate", "שלום", None]}
    for part in (slice(0, 3), slice(3, 9)):
        spark.createDataFrame([(s, k, t) for s, texts in script.items() for k, t in list(enumerate(texts))[part]], "session_id string, seq long, text string").write.mode("append").parquet(src)
        answer_stream(spark.readStream.schema("session_id string, seq long, text string").parquet(src), lambda: lines, write, point, translator=Translates).awaitTermination()
    want = {}
    for s, texts in script.items():
        state = ses.State()
        for k, t in enumerate(texts):
            done = ses.step(state, t or "", search, None, Translates())
            state = done.state
            want[s, k] = (state.query, done.output, done.should_exit)
    assert got == want and "2. To be or not to be" in got["a", 1][1]


def test_complete_stream(spark, sentences, tmp_path):
    from quillspan.streaming.sessions import complete_stream

    src = str(tmp_path / "q")
    spark.createDataFrame([(1, "to be"), (2, "zz")], "query_id long, query string").write.parquet(src)
    got = []
    rows = sentences(["To be or not to be"])
    q = complete_stream(spark.readStream.schema("query_id long, query string").parquet(src), lambda: rows, lambda df, n: got.extend(df.collect()), str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert [(r["query_id"], r["score"]) for r in got] == [(1, 10)]


# generation and translation


def answer(text):
    return {"candidates": [{"content": {"parts": [{"text": text}]}}]}


class Opener:
    def __init__(self, *replies):
        self.replies, self.requests = list(replies), []

    def __call__(self, request, timeout):
        self.requests.append((request, timeout))
        r = self.replies.pop(0)
        if isinstance(r, Exception):
            raise r
        return io.BytesIO(r if isinstance(r, bytes) else json.dumps(r).encode())


def client(*replies, **more):
    o = Opener(*replies)
    return g.SuggestionClient(api_key="k", model="m x", opener=o, environ={}, **more), o


def test_generation():
    c, o = client(answer(json.dumps(["Hello world.", "hello WORLD.", "Not the prefix.", 1, "  HELLO you "])))
    made = c.generate(" Hello ", "ctx", 3)
    assert [s.text for s in made.suggestions] == ["Hello world.", "HELLO you"] and made.model == "m x" and made.latency_ms >= 0
    request, timeout = o.requests[0]
    assert timeout == 30 and "m%20x:generateContent" in request.full_url and request.get_header("X-goog-api-key") == "k"
    body = json.loads(request.data)
    assert "<prefix>\nHello\n</prefix>" in body["contents"][0]["parts"][0]["text"] and body["generationConfig"]["responseJsonSchema"]["maxItems"] == 3


@pytest.mark.parametrize(
    ("replies", "error", "calls"),
    [
        ([answer("[]"), answer('["Hi you"]')], None, 2),
        ([b"\xff", b"{}"], InvalidResponseError, 2),
        ([urllib.error.HTTPError("u", 503, "x", {}, None), answer('["hi a"]')], None, 2),
        ([urllib.error.HTTPError("u", 404, "x", {}, None)], ContextualServiceError, 1),
        ([urllib.error.URLError("x"), TimeoutError()], ContextualServiceError, 2),
        ([b"x" * 1_000_001, answer("{}")], InvalidResponseError, 2),
        ([b"[1]", answer("not json")], InvalidResponseError, 2),
    ],
)
def test_retries(replies, error, calls):
    c, o = client(*replies)
    if error:
        with pytest.raises(error):
            c.generate("Hi", "c")
    else:
        assert len(c.generate("Hi", "c").suggestions) == 1
    assert len(o.requests) == calls


@pytest.mark.parametrize("args", [("", "c", 5), ("x" * 2001, "c", 5), ("x", " ", 5), ("x", "c" * 501, 5), ("x", "c", 0), ("x", "c", 6), ("\t\u00a0\u3000", "c", 5), ("x", "\u2003\n", 5)])
def test_request_limits(spark, args):
    c, o = client()
    with pytest.raises(ValueError) as e:
        c.generate(*args)
    got = spark.createDataFrame([args], "p string, c string, n int").select(g.request_problem_column(F.col("p"), F.col("c"), F.col("n")).alias("r")).first()["r"]
    assert got == str(e.value) and not o.requests


def test_no_key():
    with pytest.raises(ContextualConfigurationError):
        g.SuggestionClient(environ={}).generate("a", "b")


def test_prompt_columns(spark):
    df = spark.createDataFrame([("a%b $1", "c\n%s", 4)], "p string, c string, n int")
    r = df.select(g.prompt_column(F.col("p"), F.col("c"), F.col("n")).alias("t"), g.payload_column(F.col("p"), F.col("c"), F.col("n")).alias("j")).first()
    assert r["t"] == g.prompt_text("a%b $1", "c\n%s", 4)
    body = json.loads(r["j"])
    assert body["contents"][0]["parts"][0]["text"] == r["t"] and body["generationConfig"]["responseJsonSchema"] == {"type": "array", "maxItems": 4, "items": {"type": "string"}}


def test_cleaned_table(spark):
    rows = [
        (1, "Hello", json.dumps(answer(json.dumps(["Hello world.", "hello WORLD.", "no", 1, True, None, " HELLO b"])))),
        (2, "straße", json.dumps(answer(json.dumps(["STRASSE x", "Straße y"])))),
        (3, "x", "broken"), (4, "x", json.dumps(answer("{}"))), (5, "x", None), (6, "x", json.dumps(answer("not json"))),
    ]
    got = g.cleaned_suggestions(spark.createDataFrame(rows, "id int, p string, a string"), ["id"], "p", "a").orderBy("id", "rank").collect()
    assert [tuple(r) for r in got] == [(1, 1, "Hello world."), (1, 2, "HELLO b"), (2, 1, "STRASSE x"), (2, 2, "Straße y")]


def test_translation(monkeypatch):
    def service(reply=None, error=None):
        def translate_text(request, timeout):
            if error:
                raise error
            return SimpleNamespace(translations=reply)

        return g.TranslationService("p", client=SimpleNamespace(translate_text=translate_text))

    good = service([SimpleNamespace(translated_text=" hi ", detected_language_code="he")])
    assert good.translate_to_english(" שלום ") == g.Translation("שלום", "hi", "he")
    for s, text in ((good, " "), (service([]), "x"), (service([SimpleNamespace(translated_text=" ")]), "x"), (service(error=RuntimeError("boom")), "x"), (g.TranslationService("p"), "x")):
        with pytest.raises(TranslationError):
            s.translate_to_english(text)
    monkeypatch.delenv("GOOGLE_CLOUD_PROJECT", raising=False)
    with pytest.raises(TranslationError):
        g.TranslationService(client=object()).translate_to_english("x")
    for value, want in (("3.5", 3.5), ("bad", 10.0)):
        monkeypatch.setenv("TRANSLATION_TIMEOUT_SECONDS", value)
        assert g.TranslationService("p").timeout_seconds == want


# wire


def test_wire_round_trip():
    payload = wire.encode_request("to be", "AI", "ctx", 3)
    r = wire.decode_request(payload)
    assert (r.query, r.mode, r.context, r.max_results) == ("to be", 2, "ctx", 3)
    for bad in (("", "corpus", "", 5), ("x", "other", "", 5), ("x", "corpus", "", 6)):
        with pytest.raises(ValueError):
            wire.encode_request(*bad)
    with pytest.raises(ValueError):
        wire.decode_request(b"\xff\xff")
    with pytest.raises(ValueError):
        wire.decode_response(b"\xff\xff")


def test_wire_handling(spark):
    search, asked = fake_search([HIT, ses.Completion("b", "b.txt", 1, 12)])
    out = wire.decode_response(wire.handle(wire.encode_request("to be", max_results=1), search))
    assert asked == ["to be"] and out.request.query == "to be" and [s.text for s in out.suggestions] == ["b"] and out.suggestions[0].WhichOneof("origin") == "corpus"
    gen = FakeGenerator()
    raw = wire.handle(wire.encode_request("Hi", "ai"), search, gen)
    assert wire.decode_response(raw).suggestions[0].ai.model == "m" and gen.asked == [("Hi", ses.DEFAULT_CONTEXT, 5)]
    assert wire.decode_response(wire.handle(wire.encode_request("Hi", "ai"), search)).error == "AI mode requires a contextual generator"
    broken = wire.decode_response(wire.handle(b"\xff", search))
    assert broken.error == "request is not valid Protobuf data" and not broken.HasField("request")
    assert wire.decode_response(wire.handle(wire.encode_request("Hi", "ai"), search, FakeGenerator(ContextualServiceError("late")))).error == "late"
    rows = wire.decoded_responses(spark.createDataFrame([(1, bytearray(raw)), (2, None)], "id int, b binary"), "id", "b").collect()
    assert len(rows) == 1 and rows[0]["mode"] == "SEARCH_MODE_AI" and rows[0]["suggestions"][0]["corpus"] is None and rows[0]["suggestions"][0]["ai"]["model"] == "m"


def test_wire_column(spark, sentences):
    lines = sentences(["To be or not to be", "to bee", "else"])
    asked = [(1, wire.encode_request("to be", max_results=1)), (2, wire.encode_request("Hi", "ai")), (3, b"\xff"), (4, None), (5, wire.encode_request("to be")), (6, wire.encode_request("zzz"))]
    rows = {r["id"]: wire.decode_response(bytes(r["response"])) for r in wire.handled_requests(spark.createDataFrame(asked, "id int, b binary"), "id", "b", lines).collect()}
    assert [s.text for s in rows[1].suggestions] == ["To be or not to be"] and [s.text for s in rows[5].suggestions] == ["To be or not to be", "to bee"]
    assert rows[2].error == wire.NO_GENERATOR and rows[3].error == "request is not valid Protobuf data" and rows[4].error == wire.NO_QUERY and not rows[6].suggestions and not rows[6].error

    class Made:  # local, so that workers get it by value
        def generate(self, prefix, context, count=5):
            from quillspan.operators.generation import Generated, Suggestion

            return Generated((Suggestion(f"{prefix} more", "m"),), "m", 7)

    made = wire.handled_requests(spark.createDataFrame(asked[1:2], "id int, b binary"), "id", "b", lines, Made)
    assert wire.decode_response(bytes(made.first()["response"])).suggestions[0].text == "Hi more"
    blank = spark.createDataFrame([("\u00a0\t", "AI", 1)], "q string, m string, n int").select(wire.problem_column(F.col("q"), F.col("m"), F.col("n")).alias("p"))
    assert blank.first()["p"] == wire.NO_QUERY == wire.problem("\u00a0\t", 2, 1)


def test_wire_demo():
    search, _ = fake_search([ses.Completion("﻿ x", "a", 0, 1)])
    out = []
    assert wire.demo(["--query", "to be"], search, write=out.append) == 0 and out[-1] == "1. x (corpus: source=a:0, score=1)"
    assert wire.demo(["--mode", "ai"], search, write=out.append) == 1


# log


def test_log(tmp_path, monkeypatch):
    monkeypatch.setenv("AUTOCOMPLETE_LOG_LEVEL", "warning")
    path = logs.configure(path=tmp_path / "x" / "app.log")
    assert logs.configure("DEBUG", path) == path
    mine = [h for h in logging.getLogger().handlers if getattr(h, "_quillspan", False)]
    assert len(mine) == 1 and mine[0].maxBytes == 5 * 1024 * 1024 and mine[0].backupCount == 3
    logs.logger("t").warning("hello")
    mine[0].flush()
    assert "hello" in path.read_text()
    logs.configure(path=tmp_path / "other.log")
    assert len([h for h in logging.getLogger().handlers if getattr(h, "_quillspan", False)]) == 1
    with pytest.raises(ValueError):
        logs.configure("nope")
    for h in [h for h in logging.getLogger().handlers if getattr(h, "_quillspan", False)]:
        logging.getLogger().removeHandler(h)


def test_query_log_and_entry(spark, sentences):
    import __spark_entry__ as e

    assert best_completions(sentences(["a"]), "a").count() == 1
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_main(spark, archive, tmp_path, monkeypatch):
    from quillspan.__main__ import main

    monkeypatch.setenv("AUTOCOMPLETE_LOG_FILE", str(tmp_path / "a.log"))
    monkeypatch.delenv("GEMINI_API_KEY", raising=False)
    path = archive({"a.txt": "To be or not to be"})
    for more, script in (([], ["to be", "/mode ai", "x", "~"]), (["--basic"], ["to be", "~"])):
        out, typed = [], iter(script)
        assert main(["--snapshots-dir", str(tmp_path / "none"), "--zip", path, "--cache", str(tmp_path / "c"), *more], spark, lambda p: next(typed), out.append) == 0
        assert "1. To be or not to be (a.txt:0, score=10)" in "\n".join(out) and out[-1] == "Goodbye."
    for h in [h for h in logging.getLogger().handlers if getattr(h, "_quillspan", False)]:
        logging.getLogger().removeHandler(h)
