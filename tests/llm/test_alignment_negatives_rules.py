"""Alignment of tokenizers, hard negatives, quality rules: brute-force versions and edge cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_documents import documents
from tokenizers import Tokenizer

from marginalia.llm import align, negatives, rules

VECTORS = "vec_id long, embedding array<float>, label int, no long, id string, x int, anchor int, score double, rank int, list int"


def vectors(spark, rows):
    """Vectors with further columns whose names clash with those that operators use."""
    return spark.createDataFrame([(i, v, k, 9, "x", 9, 9, 9.0, 9, 9) for i, v, k in rows], VECTORS)


# alignment

TEXTS = [None, "", "plain words of a text", "  two blanks at the start", "l'été à Orléans, 😀 ñandú", "tab\tand\nnew line", "x" * 3000, "<|endoftext|> in a text </s> <s>", "▁ is changed by one", "<0x41> is text", "plain words of a text", "漢字かな交じり文 123456", " ".join(f"w{k}" for k in range(4000))]


def brute_alignment(texts):
    """Token by token, byte by byte."""
    a_path, b_path = align.default_tokenizers()
    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in own} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in own)}
    rows, counts = [], Counter()
    for text in texts:
        ia = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        ib = b.encode(text) if text else []
        ta = [bytes(byte[c] for c in a.id_to_token(i)) for i in ia]
        tb = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        raw = (" " + text).encode() if text else b""
        if b"".join(ta) != raw or b"".join(tb) != raw:
            ia, ib, ta, tb = [], [], [], []
        spans = []
        for tokens in (ta, tb):
            at, out = 0, []
            for t in tokens:
                out.append((at, at + len(t)))
                at += len(t)
            spans.append(out)
        holder = [[0] * len(raw) for _ in range(2)]
        for k, s in enumerate(spans):
            for t, (lo, hi) in enumerate(s):
                holder[k][lo:hi] = [t] * (hi - lo)
        links = sorted(set(zip(*holder, strict=True))) if ia else []
        ends = sorted({hi for _, hi in spans[0]} & {hi for _, hi in spans[1]})
        groups = [([i for i, (_, hi) in zip(ia, spans[0], strict=True) if lo < hi <= end], [i for i, (_, hi) in zip(ib, spans[1], strict=True) if lo < hi <= end]) for lo, end in zip([0, *ends], ends, strict=False)]
        rows.append((ia, ib, groups, [(ia[u], ib[v]) for u, v in links]))
        counts.update(rows[-1][3])
    best = defaultdict(int)
    for (_, v), n in counts.items():
        best[v] = max(best[v], n)
    out = []
    for ia, ib, groups, links in rows:
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(ia), len(ib), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(spelled.encode()).hexdigest() if ia else ""))
    return out


@pytest.fixture(scope="module")
def texts(spark):
    return documents(spark, [(k, t, "en", "a") for k, t in enumerate(TEXTS)]).repartition(3)


def test_alignment_against_brute_force(spark, texts):
    want = brute_alignment(TEXTS)
    got = {r.doc_id: tuple(r)[1:] for r in align.align(texts).collect()}
    assert [got[k] for k in range(len(TEXTS))] == want
    assert want[0][0] == want[1][0] == want[8][0] == 0 and all(want[k][0] for k in (2, 3, 4, 5, 6, 7, 9, 11))
    # links whose counts aren't told to all tasks are joined
    tokens = align.encoded(texts)
    counts = align.pair_counts(tokens)
    assert counts.count() > 5
    for told in (0, 5):
        assert {r.doc_id: tuple(r)[1:] for r in align.summaries(tokens, counts, told=told).collect()} == got


def test_groups_spell_the_text(spark, texts):
    both = align.tokenizers(*align.default_tokenizers())
    found = defaultdict(list)
    for r in align.groups(align.encoded(texts)).collect():
        raw = (" " + TEXTS[r.doc_id]).encode()[r.start : r.end]
        assert b"".join(both.bytes_a[i] for i in r.a) == raw == b"".join(both.bytes_b[i] for i in r.b)
        found[r.doc_id].append((r.group, r.start, r.end))
    for k, spans in found.items():
        spans.sort()
        assert [g for g, _, _ in spans] == list(range(len(spans))) and spans[0][1] == 0 and spans[-1][2] == len((" " + TEXTS[k]).encode())
        assert all(x[2] == y[1] for x, y in zip(spans[:-1], spans[1:], strict=True))


def test_alignment_of_odd_tables(spark):
    assert align.align(documents(spark, [])).count() == 0
    got = align.align(documents(spark, [(None, "no id", "en", "a"), (4, "same", "en", "a"), (4, "same", "en", "a"), (5, None, None, None)])).collect()
    assert Counter(r.doc_id for r in got) == {4: 2, None: 1, 5: 1}
    assert all(r.n_links == r.n_best > 0 and r.count_sum >= 2 * r.n_links for r in got if r.doc_id == 4)


def test_overlaps_of_random_cuts():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(1, 40)
        cuts = [sorted({n, *(rng.randint(1, n) for _ in range(rng.randint(0, n)))}) for _ in range(2)]
        lengths = [np.diff([0, *c]) for c in cuts]
        found = align.overlaps(*lengths)
        spans = [list(zip([0, *c[:-1]], c, strict=True)) for c in cuts]
        want = [(i, j) for i, (a, b) in enumerate(spans[0]) for j, (c, d) in enumerate(spans[1]) if a < d and c < b]
        assert list(zip(*(x.tolist() for x in found.links()), strict=True)) == want
        common = sorted(set(cuts[0]) & set(cuts[1]))
        for group, s in ((found.group_a, spans[0]), (found.group_b, spans[1])):
            assert group.tolist() == [sum(c < hi for c in common) for _, hi in s]


# hard negatives


def brute_negatives(rows):
    rows = [(i, v, k) for i, v, k in rows if i is not None and k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    whole = [[int(np.floor(256 * float(np.float32(x)))) for x in v] for _, v, _ in rows]
    out = Counter()
    for p, (i, v, k) in enumerate(rows):
        if i % 50:
            continue
        scores = [(-sum(x * y for x, y in zip(whole[p], whole[q], strict=True)), j, c == k) for q, (j, w, c) in enumerate(rows) if q != p and len(w) == len(v)]
        for s, j, _ in sorted(x for x in scores if x[2])[:5]:
            fits = [(t, n) for t, n, same in sorted(scores) if not same and 50 * -s <= 100 * -t <= 95 * -s]
            out.update((i, j, rank + 1, n, -s, -t) for rank, (t, n) in enumerate(fits[:3]))
    return out


def mined(df):
    return Counter(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_negatives_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(4, 6))
    rows = [(int(i), [float(x) for x in centre[i % 4] + rng.normal(size=6) * 0.7], int(rng.integers(0, 4))) for i in range(0, 400)]
    rows += [(1000 + i, rows[7][1], i % 3) for i in range(60)]  # copies: ties by id
    rows += [rows[50], (50, rows[51][1], 2), (2000, [1.0, 2.0], 1), (2050, [1.0, 2.0], 1), (2051, [1.0, 1.2], 0)]  # a repeated anchor, an id twice, another length
    rows += [(None, rows[1][1], 1), (2100, None, 1), (2150, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (2200, [float("nan")] * 6, 1), (2250, [float("inf")] * 6, 1), (2300, rows[1][1], None), (2350, [], 1), (2351, [], 2)]
    table = vectors(spark, rows).repartition(5)
    want = brute_negatives(rows)
    assert sum(want.values()) > 50 and max(want.values()) > 1
    for block in (negatives.BLOCK, 3):
        assert mined(negatives.mine(table, F.col("vec_id") % 50 == 0, block=block)) == want


def test_negatives_of_odd_tables(spark):
    anchors = F.col("vec_id") % 50 == 0
    assert negatives.mine(vectors(spark, []), anchors).count() == 0
    assert negatives.mine(vectors(spark, [(1, [1.0], 1)]), anchors).count() == 0
    assert negatives.mine(vectors(spark, [(50, [1.0], 1), (51, [1.0], 1)]), anchors).count() == 0
    huge = [(50, [1e30], 1), (51, [1e30], 1), (52, [0.8e30], 2)]
    assert negatives.mine(vectors(spark, huge), anchors).count() == 1
    assert mined(negatives.mine(vectors(spark, [(50, [1.0], 1), (51, [2.0], 1), (52, [1.5], 2), (54, [1.5], 3), (53, [-1.0], 2)]), anchors)) == {(50, 51, 1, 52, 131072, 98304): 1, (50, 51, 2, 54, 131072, 98304): 1}


# quality rules


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


PROSE = "It was late in the day when we came to a village that no map had and nobody there knew where the road would lead or who had built it so we asked for a bed and were told to wait until the fields were dark and everyone was home again for supper then someone laughed and opened a door"


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(4)

    def prose(seed):
        words = PROSE.split()
        random.Random(seed).shuffle(words)
        return " ".join(words)

    texts = {k: prose(k) for k in range(300)}
    texts |= {300 + k: " ".join(w + rng.choice(["###", "&&&", "***"]) for w in prose(k).split()) for k in range(20)}
    texts |= {320 + k: "again and again " * 30 for k in range(10)} | {330 + k: prose(k).upper() for k in range(10)}
    texts |= {340: None, 341: "", 342: " \n\t\x0b", 343: "few words", 344: "a b", 345: "a b c a b c", 346: "x\n x\nx\n\n\nx", 347: prose(1).replace(" ", " "), 348: "\U0001f600 " * 60, 349: "\n".join(["one line"] * 40), 350: " ".join(f"w{k}" for k in range(50_000)), 351: "<a>|b & c% $d #e *", 352: "漢字 " * 70}
    rows = [(k, t, "en", "a") for k, t in texts.items()] + [(3, texts[3], "en", "a"), (None, texts[4], "en", "a")]
    return rows, rules.judge(documents(spark, rows).repartition(3)).collect()


def test_measures_against_brute_force(judged):
    rows, got = judged
    texts = {k: t for k, t, _, _ in rows}
    assert Counter(r.doc_id for r in got) == Counter(k for k, *_ in rows)
    for r in got:
        n, *rest = brute_measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 50 or 100 * rest[-1] > 50 * n)
        assert not (r.base_failed and r.kept)


def test_junk_goes_and_prose_stays(judged):
    _, got = judged
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[k] for k in range(300)) and kept[None] and kept[350]
    assert not any(kept[k] for k in range(300, 346)) and not kept[349]


def test_em_against_plain_python(spark):
    rng = random.Random(8)
    patterns = Counter(tuple(rng.choice([-1, 0, 1, 1, 1, 1]) for _ in range(3)) for _ in range(500))
    share, good, bad, total = rules.SHARE, [rules.ON_GOOD] * 3, [rules.ON_BAD] * 3, 500
    for _ in range(7):
        odds = {}
        for v in patterns:
            g, b = share, 1 - share
            for x, p, q in zip(v, good, bad, strict=True):
                g *= p if x == 1 else 1 - p if x == -1 else 1
                b *= 1 - q if x == 1 else q if x == -1 else 1
            odds[v] = g / (g + b)
        share = (sum(n * odds[v] for v, n in patterns.items()) + rules.PRIOR * total * rules.SHARE) / (total * (1 + rules.PRIOR))

        def rate(j, weight, right, start, own):
            hit = sum(n * weight(odds[v]) for v, n in patterns.items() if v[j] == right)
            return (hit + own * total * start) / (sum(n * weight(odds[v]) for v, n in patterns.items() if v[j]) + own * total)

        good, bad = [rate(j, lambda p: p, 1, rules.ON_GOOD, rules.PRIOR_ON_GOOD) for j in range(3)], [rate(j, lambda p: 1 - p, -1, rules.ON_BAD, rules.PRIOR) for j in range(3)]
    found = rules.fit(spark.createDataFrame([(list(v), n) for v, n in patterns.items()], "votes array<int>, n long"), 3, 7).first()
    assert [found.share, *found.on_good, *found.on_bad] == pytest.approx([share, *good, *bad])


def test_rules_of_odd_tables(spark):
    assert rules.judge(documents(spark, [])).count() == 0
    own = (rules.Rule("short", "n_words / 1", good_to=None, most=None, good_from=60, least=55),)
    got = {r.doc_id: r.vote_short for r in rules.judge(documents(spark, [(1, "w " * 54, "", ""), (2, "w " * 57, "", ""), (3, "w " * 60, "", "")]), own).collect()}
    assert got == {1: -1, 2: 0, 3: 1}
