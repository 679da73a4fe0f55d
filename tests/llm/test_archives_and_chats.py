"""WARC archives, chat formatting, the pipeline and the registered queries."""

import base64
import collections
import gzip
import hashlib
import io
import json
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeloom.llm import chat_format, queries, warc
from tapeloom.llm.common import new_path

PAGES = "page_id long, url string, html string, record_type string"
ROWS = [
    (1, "http://a/ü?x=1 2", "<p>same</p>", "x"), (7, "http://a/2", "<p>same</p>", "x"), (3, None, "<p>same</p>", "x"), (4, "http://b\r\nWARC-Type: evil", None, "x"), (5, "u", "", "x"), (6, "u", "WARC/1.1\r\n\r\n" * 50, "x"),
    (8, "u", "é" * 200_000, "x"), (9, "u", "\x00\x01 \U0001f600", None), (9, "u", "\x00\x01 \U0001f600", None), (None, "u", "only", "x"), (None, None, "<p>same</p>", "x"),
]


def test_archives_give_back_what_was_written(spark):
    out = warc.read_warc(warc.write_warc(spark.createDataFrame(ROWS, PAGES).repartition(3), new_path(spark, "warc")), with_payload=True).collect()
    last = {}
    for i, _, h, _ in ROWS:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    sha = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    want = collections.Counter()
    for i, u, h, _ in ROWS:
        response = i == last[h or ""] or i is None and last[h or ""] == -1
        want[i, u, len((h or "").encode()), sha(h), "response" if response else "revisit", None if response else last[h or ""]] += 1
    assert collections.Counter((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out) == want
    assert all(r.digest_ok for r in out)
    assert all(bytes(r.payload).decode() in {h or "" for _, _, h, _ in ROWS} for r in out if r.record_type == "response")


def test_empty_table_writes_no_archive(spark):
    paths = warc.write_warc(spark.createDataFrame([], PAGES), new_path(spark, "warc"))
    assert paths.count() == 0 and warc.read_warc(paths).count() == 0


@given(st.lists(st.binary(max_size=300), min_size=1, max_size=8), st.integers(1, 64))
@settings(max_examples=60, deadline=None)
def test_members_are_read_incrementally(parts, chunk):
    old, warc.CHUNK = warc.CHUNK, chunk
    try:
        stream = warc.Inflated(io.BytesIO(b"".join(gzip.compress(p) for p in parts)))
        assert [b"".join(stream.take(len(p))) for p in parts] == parts and not stream.more()
    finally:
        warc.CHUNK = old


def records_of(data, with_payload=True):
    stream, out = warc.Inflated(io.BytesIO(data)), []
    while (r := warc.read_record(stream, with_payload)) is not None:
        out.append(r)
    return out


def test_a_cut_archive_and_wrong_digests_are_noticed():
    data = warc.record(1, "u", b"payload", None, "2024-01-01T00:00:00Z")
    with pytest.raises(EOFError):
        records_of(data[:-9])
    plain = zlib.decompress(data, 31)
    assert records_of(gzip.compress(plain))[0]["digest_ok"]
    assert records_of(gzip.compress(plain.replace(b"payload", b"pAyload")))[0]["digest_ok"] is False
    with pytest.raises((ValueError, EOFError)):
        records_of(gzip.compress(plain + b"more"))
    with pytest.raises(ValueError):
        records_of(gzip.compress(plain.replace(b"payload", b"longer payload")))


def test_a_bomb_is_inflated_in_pieces():
    block = b"x" * (64 << 20)
    data = gzip.compress(b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n")
    stream = warc.Inflated(io.BytesIO(data))
    most, more = 0, stream.more

    def watched():
        nonlocal most
        out = more()
        most = max(most, len(stream.ready))
        return out

    stream.more = watched
    found = warc.read_record(stream, False)
    assert found["payload_bytes"] == len(block) and most <= 2 * warc.CHUNK


def test_archives_of_other_writers(spark, tmp_path):
    def part(fields, block):
        head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
        return f"WARC/1.0\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    body = b"<html>hi</html>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
    records = [
        part({"WARC-Type": "warcinfo", "WARC-Record-ID": "<urn:uuid:1>", "Content-Type": "application/warc-fields"}, b"software: x\r\n"),
        part({"WARC-Type": "request", "WARC-Record-ID": "<urn:uuid:2>", "Content-Type": "application/http; msgtype=request"}, b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"),
        part({"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:3>", "WARC-Target-URI": "<http://a/%C3%BC>", "WARC-Payload-Digest": f"sha1:{sha}", "Content-Type": "application/http; msgtype=response"}, http + body),
        part({"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:4>", "Content-Type": "application/http;msgtype=response"}, http + body),
        part({"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:5>", "WARC-Payload-Digest": f"sha256:{hashlib.sha256(body).hexdigest()}", "Content-Type": "application/http; msgtype=response"}, http + body),
        part({"WARC-Type": "metadata", "WARC-Refers-To": "<urn:uuid:3>"}, b""),
        part({"WARC-Type": "conversion", "WARC-Record-ID": "<urn:uuid:7>", "WARC-Block-Digest": "crc32:1", "Content-Type": "text/plain"}, b"plain\r\n\r\ntext"),
        part({"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:8>", "WARC-Payload-Digest": "sha1:AAAA", "Content-Type": "application/http; msgtype=response"}, b"no headers at all"),
    ]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "two.warc.gz").write_bytes(gzip.compress(records[0] + records[3]))  # two records in one member
    names = spark.createDataFrame([(str(path), 1), (str(tmp_path / "two.warc.gz"), 1)], "path string, bytes long")
    out = warc.read_warc(names, with_payload=True).collect()
    by_id = {r.record_id: r for r in out}
    assert len(out) == 10 and all(r.page_id is None for r in out)
    assert {r.record_type for r in out} == {"warcinfo", "request", "response", "metadata", "conversion"}
    assert [by_id[f"urn:uuid:{i}"].digest_ok for i in (1, 2, 3, 4, 5, 7, 8)] == [None, None, True, None, True, None, False]
    assert bytes(by_id["urn:uuid:3"].payload) == body and by_id["urn:uuid:4"].payload_digest == sha and by_id["urn:uuid:3"].url == "http://a/ü"
    assert by_id[None].refers_to_id == "urn:uuid:3" and by_id[None].payload_bytes == 0 and bytes(by_id["urn:uuid:7"].payload) == b"plain\r\n\r\ntext"
    assert bytes(by_id["urn:uuid:8"].payload) == b"no headers at all"


ODD = st.text(alphabet=st.sampled_from(list("<|im_start>end[/INST]</s>\n\x1b012 user")), max_size=60)


@given(st.lists(st.tuples(ODD, ODD), max_size=5))
@settings(max_examples=300, deadline=None)
def test_formatting_is_reversible_and_leaves_no_control_string(turns):
    out = [chat_format.format_turn(r, t) for r, t in turns]
    assert chat_format.read_turns("".join(f for f, _, _ in out)) == turns
    for (role, text), (f, a, b) in zip(turns, out, strict=True):
        body = chat_format.escape(text)
        assert not any(c in body for c in chat_format.CONTROL)
        assert f.count(chat_format.START) == 1 and f.count("<|im_end|>") == 1
        assert chat_format.unescape(f[a:b]) == (text if role == "assistant" else "")


def test_layouts_are_chosen_by_their_paths(spark):
    records = [
        {"conv_id": 1, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]}, {"conv_id": 2, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"conv_id": 3, "prompt": "q", "completion": "a"}, {"conv_id": 4, "instruction": "q", "output": "a"}, {"conv_id": 5, "instruction": "s", "input": "q", "output": "a"}, {"conv_id": 6, "data": {"prompt": "q", "response": "a"}},
        {"conv_id": 7, "turn": 3, "role": "human", "text": "q"}, {"conv_id": 8, "what": "?"}, [1], None,
    ]
    rows = [(json.dumps(r),) for r in records] + [("not json",), (None,)]
    out = chat_format.canonical_turns(spark.createDataFrame(rows, "record string")).collect()
    turns = collections.defaultdict(list)
    for r in out:
        turns[r.conv_id].append((r.layout.split(":")[0], r.turn, r.role, r.text))
    assert turns[1] == [("messages", 0, "user", "q"), ("messages", 1, "assistant", "")]
    assert turns[2] == [("from_value", 0, "user", "q"), ("from_value", 1, "assistant", "a")]
    assert [turns[i][0][0] for i in (3, 4, 5, 6)] == ["prompt", "instruction", "instruction", "nested_prompt"]
    assert [x[2:] for x in turns[5]] == [("user", "s\n\nq"), ("assistant", "a")]
    assert turns[7] == [("turn_row", 3, "human", "q")]
    assert turns[8][0][0] == "unknown" and len(turns[None]) == 4


def test_layouts_take_optional_fields(spark):
    records = [
        {"conv_id": 1, "messages": []}, {"conv_id": 2, "messages": [{"role": "human", "content": "q", "name": "x"}], "source": "web"}, {"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]},
        {"conv_id": 4, "prompt": "q", "response": "a"}, {"conv_id": 5, "instruction": "i", "input": "", "output": "a", "system": "be kind"}, {"conv_id": 6, "question": "q", "context": "c", "answer": None}, {"conv_id": "seven", "prompt": "q", "completion": "a"}, {"conv_id": 8, "messages": "no list"},
    ]
    turns = collections.defaultdict(list)
    out = chat_format.canonical_turns(spark.createDataFrame([(json.dumps(r),) for r in records], "record string"))
    for r in out.collect():
        turns[r.conv_id].append((r.layout, r.role, r.text))
    assert turns[1] == [("messages", None, None)] and turns[8][0][0].startswith("unknown:") and turns[2] == [("messages", "user", "q")]
    assert turns[4] == [("prompt_response", "user", "q"), ("prompt_response", "assistant", "a")]
    assert [x[1:] for x in turns[5]] == [("system", "be kind"), ("user", "i"), ("assistant", "a")]
    assert [x[1:] for x in turns[6]] == [("user", "q\n\nc"), ("assistant", "")]
    assert turns[None] == [("messages", "user", "ab"), ("prompt", "user", "q"), ("prompt", "assistant", "a")]
    assert chat_format.format_chats(out).count() == out.count() - 2


def test_two_attempts_of_a_task_leave_each_others_archives_alone(spark, tmp_path, monkeypatch):
    records = [warc.record(i, None, b"x" * i, None, "2020-01-01T00:00:00Z") for i in range(60)]

    class Attempt:
        def __init__(self, n):
            self.n = n

        def partitionId(self):  # noqa: N802
            return 0

        def taskAttemptId(self):  # noqa: N802
            return self.n

    written = []
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3_000)
    for attempt, order in ((7, records), (8, records[::-1])):  # the second gets its rows in another order, and cuts elsewhere
        monkeypatch.setattr(warc.TaskContext, "get", lambda n=attempt: Attempt(n))
        a = warc.Archives(str(tmp_path))
        written.append(a)
    for first, second in zip(records, records[::-1], strict=True):  # both write at once
        written[0].put(first)
        written[1].put(second)
    monkeypatch.undo()
    for a in written:
        a.close()
        paths = spark.createDataFrame([(f"{tmp_path}/{name}", size) for name, size in a.done], "path string, bytes long")
        assert len(a.done) > 1 and sorted(r.page_id for r in warc.read_warc(paths).collect()) == list(range(60))


#: Records of usual fields in unusual places, and the turns that they are; None: unknown, never an empty turn.
UNUSUAL = [
    ({"messages": [{"from": "human", "value": "hi"}]}, [("user", "hi")]),
    ({"conversations": [{"role": "user", "content": "hi"}]}, [("user", "hi")]),
    ({"conversation": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "ho"}]}, [("user", "hi"), ("assistant", "ho")]),
    ({"messages": [{"role": "user", "text": "hi"}]}, [("user", "hi")]),
    ({"dialogue": ["hello"]}, None),
    ({"messages": "hi"}, None),
    ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "body": "lost?"}]}, None),
    ({"messages": [{"role": "user", "content": "hi"}, "bare"]}, None),
    ({"data.prompt": "q", "data.response": "a"}, None),
    ({"prompt": "q", "completion": "a", "messages": []}, [("user", "q"), ("assistant", "a")]),
    ({"prompt": "q", "chosen": "good", "rejected": "bad"}, [("user", "q"), ("assistant", "good")]),
    ({"prompt": "q", "chosen": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "good"}], "rejected": []}, [("user", "q"), ("assistant", "good")]),
    ({"chosen": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "good"}], "rejected": [{"role": "user", "content": "q"}]}, [("user", "q"), ("assistant", "good")]),
    ({"prompt": [{"role": "system", "content": "s"}, {"role": "user", "content": "q"}], "completion": [{"role": "assistant", "content": "a"}]}, [("system", "s"), ("user", "q"), ("assistant", "a")]),
    ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": None, "tool_calls": [{"id": 1}]}]}, [("user", "hi"), ("assistant", '[{"id": 1}]')]),
    ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "tool_calls": [{"id": 1}]}]}, [("user", "hi"), ("assistant", '[{"id": 1}]')]),
]


def test_no_text_is_lost_under_a_layouts_name(spark):
    rows = [(json.dumps({"conv_id": i, **r}),) for i, (r, _) in enumerate(UNUSUAL)]
    out = collections.defaultdict(list)
    for r in chat_format.canonical_turns(spark.createDataFrame(rows, "record string")).orderBy("conv_id", "turn").collect():
        out[r.conv_id].append(r)
    for i, (_, turns) in enumerate(UNUSUAL):
        if turns is None:
            assert [(r.layout[:8], r.text) for r in out[i]] == [("unknown:", None)], UNUSUAL[i]
        else:
            assert [(r.role, r.text) for r in out[i]] == turns, UNUSUAL[i]


def test_fingerprints_are_of_nested_paths():
    mark = lambda x: chat_format.fingerprint(chat_format.field_paths(x))
    a, b = {"messages": [{"role": "user", "content": "hi"}]}, {"messages": [{"from": "human", "value": "hi"}]}
    assert mark(a) != mark(b) and mark(a) == mark({"messages": [{"content": "x", "role": "y"}, {"content": "z", "role": "y"}]})
    assert mark({"a.b": 1}) != mark({"a": {"b": 1}}) and mark({"a": []}) != mark({"a": [1]})
    deep = "x"
    for _ in range(2_000):
        deep = [deep]
    assert len(chat_format.field_paths(deep)) == 2_000
    mappings = chat_format.Mappings()
    for i in range(chat_format.REMEMBERED + 10):
        assert mappings.find(chat_format.field_paths({f"k{i}": 1}))[1] is None
    assert len(mappings.known) <= chat_format.REMEMBERED and mappings.find(chat_format.field_paths(a))[1].name == "messages"


def test_digests_of_conversations(spark):
    rows = [(1, 1, "assistant", "é\n"), (1, 0, "user", None), (1, 2, None, "x"), (2, None, "assistant", "<s>"), (2, 5, "assistant", "b"), (None, 0, "user", "n"), (3, 0, "user", ""), (4, 0, "assistant", "same"), (4, 0, "assistant", "same")]
    rows += [(5, i, ["user", "assistant"][i % 2], f"turn {i}") for i in range(500)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    out = {r.conv_id: r for r in chat_format.digests(chat_format.format_chats(turns)).collect()}
    groups = collections.defaultdict(list)
    for c, t, r, x in rows:
        groups[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(out) == set(groups)
    for c, g in groups.items():
        g.sort(key=lambda x: x[0])
        loss = "".join(x for _, r, x in g if r == "assistant")
        r = out[c]
        assert (r.n_turns, r.loss_chars) == (len(g), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{x}\n" for _, a, x in g).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.digests(chat_format.format_chats(none)).count() == 0


def test_pipeline_stages_keep_what_they_should(spark, docs, corpus, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tapeloom.llm.common import staged

    now, n = docs.withColumnsRenamed({"kept": "kept_id", "fp": "kept_mark", "mix_pass": "mix_id", "size": "mix_src", "anchor": "row", "data": "mix_row", "block": "mix_hash"}), []
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES:
        before = now
        now = staged(stage(spark, now, str(tmp_path)), name.replace(" ", "-"))
        n.append(now.count())
        assert name == "SentencePiece" or now.columns == columns
        if name == "language ID":
            said = {(i, t): x for i, t, x, *_ in corpus}
            assert all(said[r.doc_id, r.text] in (r.lang, None) for r in now.collect()) and now.filter("lang is null").count() < before.filter("lang is null").count()
            assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in now.collect()) == sorted((i is None, i or 0, t) for i, t, *_ in corpus if t and any(map(str.isalpha, t)))
        if name == "exact dedup":
            norm = lambda t: "".join(t.split(" ")).replace("\n", "").replace("\t", "").replace("\r", "")
            assert now.count() == len({norm(r.text) for r in before.collect()}) == len({norm(r.text) for r in now.collect()})
        if name == "SimHash near-dedup":
            from tapeloom.llm.simhash_dedup import simhash_groups

            groups = simhash_groups(before).select("component_root").distinct().count()
            assert now.count() == groups
        if name == "mixing sources":
            assert {r.text for r in now.collect()} == {r.text for r in before.collect()}
            from tapeloom.llm import mixing

            order = [r.text for r in mixing.mix(before).orderBy("mix_order").collect()]
            assert [r.text for r in stage(spark, before, str(tmp_path)).collect()] == order
    assert n[0] > n[1] >= n[2] <= n[3] == n[4]
    assert all(r.round_trip for r in now.collect())


def test_pipeline_over_an_empty_table(spark, nothing, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    now = nothing
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
    assert now.count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_duckdb(spark, name):
    import os

    import duckdb

    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    wanted = con.sql(queries.ORACLES[name])
    columns = sorted(wanted.columns)
    found = queries.QUERIES[name](spark, sf)
    assert sorted(found.columns) == columns
    assert collections.Counter(map(tuple, found.select(*columns).collect())) == collections.Counter(wanted.select(", ".join(f'"{c}"' for c in columns)).fetchall() if hasattr(wanted, "fetchall") else con.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_queries_without_sql_have_a_row_for_each_document(spark, name):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert collections.Counter(r.doc_id for r in out.select("doc_id").collect()) == collections.Counter(r.doc_id for r in docs.select("doc_id").collect())
    if "held_out" in out.columns:
        n, held = {"op4": (3, 1), "op5": (10, 0), "op11": (4, 2)}[name.split("_")[0]]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == held) for r in out.select("doc_id", "held_out").collect())
