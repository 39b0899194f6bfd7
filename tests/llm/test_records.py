"""Operators on conversations, pages and embeddings."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import math
import uuid

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import chat, embeddings, graph, queries, warc


@given(st.text(alphabet="<s>/[INST] \\u{3c}ab", max_size=40))
@settings(max_examples=500, deadline=None)
def test_escaping_is_reversible_and_leaves_no_control(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROLS)


def test_layouts(spark):
    records = [
        (1, {"messages": [{"role": "system", "content": "be brief"}, {"role": "human", "content": "hi"}, {"role": "assistant", "content": None}]}),
        (2, {"instruction": "add", "input": "1 2", "output": "3"}),
        (3, {"instruction": "add", "output": "3"}),
        (4, {"prompt": "p", "completion": "c"}),
        (5, {"question": "q", "answer": {"text": "a"}}),
        (6, {"conversations": [{"from": "human", "value": "</s>"}, {"from": "gpt", "value": "[INST]"}]}),
        (7, {"strange": 1}),
        (8, {"messages": []}),
    ]
    rows = [(i, json.dumps(x), "clash", 1) for i, x in records] + [(9, None, "clash", 1), (10, "not json", "clash", 1)]
    df = spark.createDataFrame(rows, "id long, record string, formatted string, ord int")
    got = chat.format_records(df, "record", ["id"]).collect()
    turns = {}
    for r in got:
        turns.setdefault(r.id, []).append(chat.read_turn(r.formatted) if r.formatted else r.layout)
    assert turns[1] == [("system", "be brief"), ("user", "hi"), ("assistant", "")]
    assert turns[2] == [("user", "add\n\n1 2"), ("assistant", "3")] and turns[3] == [("user", "add"), ("assistant", "3")]
    assert turns[4] == [("user", "p"), ("assistant", "c")] and turns[5] == [("user", "q"), ("assistant", "a")]
    assert turns[6] == [("user", "</s>"), ("assistant", "[INST]")]
    assert turns[7] == turns[8] == turns[9] == turns[10] == [None]
    for r in got:
        if r.formatted:
            role, text = chat.read_turn(r.formatted)
            assert chat.unescape(r.formatted[r.loss_start : r.loss_end]) == (text if role == "assistant" else "")
    assert chat.fingerprint(chat.field_paths({"b": 1, "a": [{"x": 1}, {"x": None}]})) == chat.fingerprint({"a[].x", "b"})


def test_conversations(spark, small):
    got = {r.conv_id: r for r in queries.op1_chat(spark, small).collect()}
    turns = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{small}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    assert set(got) == set(turns)
    for k, v in turns.items():
        loss = "".join(t for role, t in v if role == "assistant")
        assert (got[k].n_turns, got[k].loss_chars) == (len(v), len(loss))
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in v).encode()).hexdigest()
        assert got[k].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<s>x"]), st.text(alphabet="</s>[INST]\\\\ ab\n", max_size=30)), max_size=5))
@settings(max_examples=200, deadline=None)
def test_turns_are_found_in_a_whole_conversation(turns):
    joined = "".join(f"{chat.TURN}{chat.escape(r)}{chat.HEAD}{chat.escape(t)}{chat.TAIL}" for r, t in turns)
    assert chat.read_turns(joined) == (turns, "")
    assert chat.read_turns(joined + chat.TURN[:2])[0] == turns
    with pytest.raises(ValueError, match="no turn"):
        chat.read_turns(joined + "junk")


PAGES = "page_id long, url string, html string, digest string, refers_to long, __salt int"


def test_archives(spark):
    big = "<p>é" * 60_000
    rows = [(5, "http://a/ b\n", "x" * 100), (3, None, "x" * 100), (9, "u", "x" * 100), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", big), (8, "u", big), (3, None, "x" * 100), (None, "u", "y" * 200), (None, "u", "y" * 200), (11, "u", "a\r\n\r\nb" * 50)]
    pages = spark.createDataFrame([(*r, "d", 1, 1) for r in rows], PAGES)
    got = warc.store_and_read(pages).collect()
    assert len(got) == len(rows)
    html = {p: (h or "").encode() for p, _, h in rows}
    for r in got:
        assert (r.payload_bytes, r.payload_digest) == (len(html[r.page_id]), hashlib.sha256(html[r.page_id]).hexdigest())
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in got}
    assert kinds == {(5, "revisit", 3), (3, "response", None), (9, "revisit", 3), (1, "response", None), (2, "response", None), (4, "response", None), (6, "response", None), (7, "response", None), (8, "revisit", 7), (None, "response", None), (11, "response", None)}
    payloads = {r.page_id: r.payload for r in warc.read_warc(warc.write_archives(pages)).filter("record_type = 'response'").collect()}
    assert all(bytes(payloads[p]) == html[p] for p in payloads)
    assert warc.store_and_read(pages.limit(0)).count() == 0


def test_reader_finds_damage():
    good = warc.record(1, "http://a/", b"hello" * 50, hashlib.sha256(b"hello" * 50).hexdigest(), None, False)
    assert len(list(warc.read_archive(good + good))) == 2 and list(warc.read_archive(b"")) == []
    wrong = warc.record(1, "http://a/", b"hello", "0" * 64, None, False)
    for bad in (good[:-9], good + b"junk", wrong, good[:20] + b"\0\0" + good[22:]):
        with pytest.raises((warc.WarcError, OSError)):
            list(warc.read_archive(bad))


def member(fields, block, digests=True, line=b""):
    """A record as other tools write it: sha1 in base32, UUID ids."""
    sha1 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    head = {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, str(fields))}>", "WARC-Date": "2020-01-01T00:00:00Z", **fields, **({"WARC-Block-Digest": sha1(block)} if digests else {}), "Content-Length": str(len(block))}
    return gzip.compress(b"WARC/1.0\r\n" + line + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n")


def test_reader_of_standard_archives(spark, tmp_path):
    sha1 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    body = b"<html>" + b"x" * 300_000
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    coded = b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in (body[:1000], body[1000:])) + b"0\r\n\r\n"
    archive = b"".join([
        member({"WARC-Type": "warcinfo", "Content-Type": "application/warc-fields"}, b"software: some\r\nformat: WARC File Format 1.0\r\n"),
        member({"WARC-Type": "request", "WARC-Target-URI": "http://a/é?x=1", "Content-Type": "application/http; msgtype=request"}, b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"),
        member({"WARC-Type": "response", "WARC-Target-URI": "http://a/é?x=1", "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": sha1(body)}, http + body),
        member({"WARC-Type": "response", "WARC-Target-URI": "http://b/", "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": sha1(body)}, chunked + coded),
        member({"WARC-Type": "metadata", "Content-Type": "application/warc-fields"}, b"", digests=False),
        member({"WARC-Type": "revisit", "WARC-Target-URI": "http://a/", "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": sha1(body)}, http),
        member({"WARC-Type": "resource", "WARC-Target-URI": "file://a", "Content-Type": "text/plain"}, b"plain text", line=b"X-Long: one\r\n two\r\n"),
    ])
    (tmp_path / "one.warc.gz").write_bytes(archive)
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"no archive")
    got = warc.read_warc_files(spark, str(tmp_path)).collect()
    assert [r.record_type for r in got] == ["warcinfo", "request", "response", "response", "metadata", "revisit", "resource"]
    assert all(r.page_id is None and r.record_id.startswith("<urn:uuid:") for r in got)
    assert bytes(got[2].payload) == body and got[2].payload_digest == hashlib.sha256(body).hexdigest() and got[2].url == "http://a/é?x=1"
    assert bytes(got[3].payload) == coded and bytes(got[6].payload) == b"plain text" and got[5].payload is None and got[5].payload_digest == sha1(body)
    assert [r.payload_bytes for r in got] == [46, 0, len(body), len(coded), 0, None, 10]
    bad = member({"WARC-Type": "response", "Content-Type": "application/http", "WARC-Payload-Digest": sha1(b"other")}, http + body)
    with pytest.raises(warc.WarcError, match="payload"):
        list(warc.read_archive(bad))


def brute(rows, least=0.9):
    x = [np.array(v, float) if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v) else None for _, v in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i, a in enumerate(x):
        for j in range(i):
            b = x[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    ids = {}
    for i, (k, _) in enumerate(rows):
        ids[find(i)] = min(k, ids.get(find(i), k))
    return sorted((k, links[i], ids[find(i)], ids[find(i)] == k) for i, (k, _) in enumerate(rows))


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "PER_CELL", 12)
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    monkeypatch.setattr(embeddings, "CHUNK", 20)
    monkeypatch.setattr(embeddings, "SUB", 5)
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(12):
        base = rng.normal(size=16)
        rows += [(len(rows), v.astype(np.float32).tolist()) for v in base + rng.normal(size=(9, 16)) * rng.choice([0.05, 0.2])]
    rows += [(500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] + [1.0] * 15), (504, [None] + [1.0] * 15), (505, rows[0][1]), (506, rows[0][1]), (508, [float("inf")] + [1.0] * 15), (509, [2 * v for v in rows[20][1]])]
    rows += [(600, [1.0, 2.0]), (601, [1.0, 2.5]), (602, [2.0, -1.0]), (603, [1.0, 2.0, 0.0])]  # each length is compared by itself
    df = spark.createDataFrame([(k, v, 1, 2, 3) for k, v in rows], "vec_id long, embedding array<float>, label int, cell int, copies int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect())
    assert got == brute(rows) and next(r for r in got if r[0] == 601)[1] == 1
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    assert embeddings.near_duplicates(df.filter("vec_id IN (500, 502)")).count() == 2


def test_embeddings_in_double_precision(spark):
    tiny = math.acos(0.9)
    rows = [(1, [1.0, 0.0]), (2, [math.cos(tiny - 1e-12), math.sin(tiny - 1e-12)]), (3, [math.cos(tiny + 1e-12), -math.sin(tiny + 1e-12)]), (4, [1e300, 1e290]), (5, [-1e300, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.n_links) for r in embeddings.near_duplicates(df).collect()) == [(1, 2), (2, 2), (3, 0), (4, 2), (5, 0)]


@pytest.mark.parametrize("rank", [4, 8, 64])
def test_embeddings_lose_no_link_whatever_their_rank(spark, monkeypatch, tmp_path, rank):
    monkeypatch.setattr(embeddings, "PER_CELL", 75)
    monkeypatch.setattr(embeddings, "BLOCK", 128)
    monkeypatch.setattr(embeddings, "CHUNK", 256)
    monkeypatch.setattr(embeddings, "SUB", 20)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, rank)) @ rng.normal(size=(rank, 64))
    x[300:] = x[:300] + rng.normal(size=(300, 64)) * np.abs(x[:300]).mean() * rng.choice([0.3, 0.45, 0.6], (300, 1)) if rank == 64 else x[300:]
    spark.createDataFrame([(k, v.astype(np.float32).tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in queries.op9_embeddings(spark, str(tmp_path)).collect())
    x = x.astype(np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= embeddings.COSINE).sum(axis=1) - 1
    assert links.sum() > 50 and [r[1] for r in got] == links.tolist()  # a recall of 1
    assert got == brute([(k, v.tolist()) for k, v in enumerate(x)])


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(int(a), int(b)) for a, b in rng.integers(100, 300, (120, 2))] + [(400, 400), (500, 501), (501, 500)]
    nodes, root = graph.forest(np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    want = {int(n): int(r) for n, r in zip(nodes, root, strict=True) if n != 400 or r != 400}
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = {r.node: r.component for r in graph.components(df).collect()}
    assert {k: v for k, v in got.items()} == {k: v for k, v in want.items() if k in got} and set(want) - set(got) <= {n for n in want if want[n] == n}
    assert graph.components(df.limit(0)).count() == 0
