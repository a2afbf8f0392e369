"""Each operator against a brute-force version, and the defined results of the odd cases."""

import hashlib
import itertools
import math
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import pytest
from conftest_llm import SF, duck, rows_of

from pixelframe.llm import chat, decontaminate, nbest, ngram_join, pii, quality_model, quality_rules, sharding, token_files, unit_dedup
from pixelframe.llm.pretokens import Encoder
from pixelframe.llm.queries import ORACLE_SQL, QUERIES

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    got, want = rows_of(QUERIES[name](spark, SF)), duck(ORACLE_SQL[name])
    assert got[0] == want[0]
    assert got[1] == want[1]


# --- op1 -----------------------------------------------------------------------------------

PLAIN = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_spans(t):
    out = []
    for kind, p in PLAIN:
        mine = []
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            mine.append((kind, m.start(), m.end()))
        out.append(mine)
    return out



def test_pii_base(spark, written_docs):
    rng = random.Random(5)
    parts = ["a@b.co", "x.y@z", "@", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "007.08.09.010", "4111 1111 1111 1111", "4111111111111112", "12-34", "+1 (212) 555-0123", "+49 30", "é", "\U0001f600", " ", ",", "..", "a@b.c-d+e@f.gh", "+1234567890123456789"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "\n", "x"]) for _ in range(rng.randrange(1, 12))) for _ in range(300)] + [None, "", "a" * 5000 + "@b.cd", "1" * 5000, "a@" + "b." * 3000 + "c"]
    got = {r.doc_id: r for r in pii.op1_weak_supervision(spark, written_docs(texts)).collect()}
    for i, t in enumerate(texts):
        spans = plain_spans(t or "")
        named = ",".join(f"{k}:{a}:{b}" for x in spans for k, a, b in x)
        assert [len(x) for x in spans] == [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone], t
        assert got[i].base_sha256 == hashlib.sha256(named.encode()).hexdigest()
        assert set(named.split(",")) - {""} <= set(got[i].spans.split(","))


def test_pii_many(spark):
    """Many matches in one text: each at its place, in time in proportion to them, and redacted; candidates that overlap a base span go, whichever comes first."""
    n = 5_000
    text = "\U0001f600 log " + "".join(f"10.0.{i % 256}.{i % 199} u{i}@x.org (212) 555-{i % 10000:04d}\n" for i in range(n))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    model = pii.fit(pii.vote_counts(pii.candidates(docs)))
    began = time.perf_counter()
    spans = pii.detect(docs, model).collect()[0].spans
    base = [(s.kind, s.start, s.end) for s in spans if s.base]
    assert sorted(base) == sorted(x for kind in plain_spans(text) for x in kind)
    out = pii.redact(docs, model).collect()[0].text
    assert out.count("[EMAIL]") == out.count("[IP]") == n and "@" not in out and out.startswith("\U0001f600 log [IP] [EMAIL]")
    assert time.perf_counter() - began < 60


@pytest.mark.parametrize("size", [0, 1, 5, 64, 65, 1000])
def test_running(spark, size):
    from pyspark.sql import functions as F

    from pixelframe.llm.common import running

    rng = random.Random(size)
    v = [rng.randrange(100) for _ in range(size)]
    df = spark.createDataFrame([(v,)], "v array<int>")
    assert df.select(running(F.col("v"), lambda a, b: a + b, F.lit(0))).first()[0] == [0, *itertools.accumulate(v)][:size]
    assert df.select(running(F.col("v"), lambda a, b: F.greatest(a, b), F.lit(0))).first()[0] == [0, *itertools.accumulate(v, max)][:size]


def test_pii_apart(spark):
    span = lambda a, b, base: (a, b, "ip", base, [1])
    rng = random.Random(8)
    for _ in range(3):
        rows = [span(a := rng.randrange(300), a + rng.randrange(1, 12), rng.random() < 0.4) for _ in range(120)]
        df = spark.createDataFrame([(rows,)], f"s array<{pii.SPAN}>")
        got = sorted(tuple(x)[:4] for x in df.select(pii._apart(df.s)).first()[0])
        want = sorted(x[:4] for x in rows if x[3] or not any(y[3] and y[0] < x[1] and x[0] < y[1] for y in rows))
        assert got == want


def test_redact_overlaps(spark):
    """Overlapping spans of several kinds become one mark."""
    docs = spark.createDataFrame([(1, "x 4111 1111 1111 1111 y 1.2.3.4@b.co z", "k")], "doc_id long, text string, spans string")
    (row,) = pii.redact(docs, pii.fit([])).collect()
    assert row.text == "x [CARD] y [IP] z" and row.spans == "k"


def test_pii_model(spark):
    counts = [("card", True, (1, 1, 0, 1), 100), ("card", False, (-1, -1, 0, 1), 50), ("phone", True, (1, 1, 0, 1), 90), ("phone", False, (1, 1, 0, 1), 3), ("phone", False, (-1, -1, -1, -1), 20)]
    m = pii.fit(counts)
    assert m.reliability["regex"][0] > 0.9 > 0.3 > m.reliability["regex"][1]
    score = lambda kind, v: m.bias[kind] + sum(w * x for w, x in zip(m.weights, v, strict=True))
    assert score("phone", (1, 1, 0, 1)) > 3 > 0 > score("card", (-1, -1, 0, 1))
    assert pii.fit([]).weights


def test_pii_odd(spark, docs, none):
    model = pii.fit(pii.vote_counts(pii.candidates(docs)))
    out = pii.redact(docs, model)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[10].text == "mail me at [EMAIL] or [PHONE] from [IP], card [CARD]."
    assert got[0].text is None and got[5].text and got[1].text == "" and got[10].spans == "z"
    assert out.count() == docs.count() and pii.redact(none, pii.fit([])).count() == 0


# --- op2 -----------------------------------------------------------------------------------


def test_chat(spark):
    part = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
    p = lambda kind, **k: {"type": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | k
    nasty = "a <|turn|>user\nb <|end|> &lt; [INST] &amp; \\"
    rows = [
        (1, 0, "user", [p("text", text=nasty), p("image", ref="i.png", width=28, height=29), p("text", text="x"), p("audio", ref="s", seconds=1.5), p("document", ref="d", pages=3)]),
        (1, 1, "assistant", [p("text", text=nasty)]),
        (1, 1, None, None),
        (2, 0, "assistant", [p("text", text=None)]),
        (2, 0, "assistant", [p("text", text=None)]),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>")
    out = chat.format_chats(df)
    got = {r.conv_id: r for r in out.collect()}
    assert [(a.type, a.ref, a.tokens, a.turn, a.part) for a in got[1].attachments] == [("image", "i.png", 6, 1, 1), ("audio", "s", 38, 1, 3), ("document", "d", 1536, 1, 4)] and got[1].n_expanded == 6 + 38 + 1536
    back = {r.conv_id: r for r in chat.read_back(out).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("user", nasty + "<|image|>x<|audio|><|document|>"), ("", ""), ("assistant", nasty)]
    assert back[1].loss_text == nasty and back[2].loss_text == "" and len(back[2].turns) == 2
    assert "[INST]" not in got[1].formatted
    with pytest.raises(Exception, match="unknown part type"):
        chat.format_chats(spark.createDataFrame([(1, 0, "user", [p("video")])], df.schema)).collect()
    assert chat.format_chats(df.limit(0)).count() == 0


# --- op3 -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def seg():
    import public_tokenizers

    return nbest.Segmenter(public_tokenizers.path("piece_bpe_32k.model"), 4)


def all_segmentations(p, text):
    m, out = nbest.marked(text), []
    arcs = p.arcs(m)

    def go(end, score, ids):
        if end == 0:
            out.append((score, ids))
        for s, v, i in arcs[end]:
            go(s, score + v, (p.expand(m[s]) if i < 0 else [i]) + ids)

    go(len(m), 0.0, [])
    return sorted(out, key=lambda x: -x[0])


def test_nbest(seg):
    rng = random.Random(2)
    texts = ["", "a", "  a b", " ", "hello  world", "日本é the", "x\ty\nz", "<s> a"] + ["".join(rng.choice("abthe é \n日") for _ in range(rng.randrange(1, 11))) for _ in range(60)]
    for t, (lists, scores) in zip(texts, seg(texts), strict=True):
        want = all_segmentations(seg.p, t)
        assert scores == pytest.approx([s for s, _ in want[:4]]) and len(lists) == len(scores) == min(4, len(want))
        assert len({tuple(x) for x in lists}) == len(lists)
        for ids, score in zip(lists, scores, strict=True):
            assert seg.p.decode(ids.tolist()) == t and seg.p.decoded(ids) == t.encode()
            assert any(ids.tolist() == i for s, i in want if s == pytest.approx(score))


def test_nbest_agreement(seg):
    """The best segmentation is close to the library's, in pieces and in their number."""
    import sentencepiece
    import public_tokenizers

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["the quick brown fox jumps over the lazy dog", "It was the best of times, it was the worst of times, it was the age of wisdom.", "A large cluster reads many files at the same time and writes its results to shared storage."]
    assert next(seg(texts))[0][0].tolist() == lib.encode(texts[0])
    ours, theirs = [x[0][0].tolist() for x in seg(texts)], [lib.encode(t) for t in texts]
    assert sum(map(len, ours)) <= 1.1 * sum(map(len, theirs))
    assert sum(len(set(a) & set(b)) for a, b in zip(ours, theirs, strict=True)) >= 0.85 * sum(len(set(b)) for b in theirs)


def test_nbest_ties(seg, monkeypatch):
    """Long and short chunks take different steps to the same lists and scores, ties included."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 20))) + " " + "e" * rng.randrange(30) for _ in range(80)]
    short = [(x[0].tolist(), s) for x, s in seg(texts)]
    monkeypatch.setattr(nbest, "LONG", 2)
    for (ids, scores), (lists, again) in zip(short, seg(texts), strict=True):
        assert ids == lists[0].tolist() and scores == pytest.approx(again)


def test_nbest_long(seg):
    word = "".join(random.Random(3).choice("abcdefgh") for _ in range(300))
    (lists, scores), (same, _) = seg([word, word])
    got = seg.p.nbest(nbest.marked(word), 4)
    assert [x.tolist() for x in lists] == [i for _, i in got] and lists[0].tolist() == same[0].tolist() and scores == pytest.approx([s for s, _ in got])
    assert scores == sorted(scores, reverse=True)


def test_nbest_odd(spark, docs, none):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    out = nbest.segmented(docs, path)
    got = {(r.doc_id, r.w): r for r in out.collect()}
    assert got[0, "x"].n_pieces == got[1, "x"].n_pieces == 0 and list(got[1, "x"].scores) == [0.0]
    assert all(r.decodes for r in got.values()) and out.count() == docs.count()
    assert all(len(r.segmentations) == len(r.scores) == r.n_segmentations and list(r.segmentations[0]) == list(r.ids) for r in got.values())
    assert nbest.segmented(none, path).count() == 0


# --- op4 -----------------------------------------------------------------------------------


def test_units(spark, docs, none):
    for unit in ("line", "paragraph"):
        out = unit_dedup.removals(docs, unit=unit)
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.start, r.end, r.kept_in) for r in out.collect())
        assert {g[0] for g in got} == {-1, 6, 7} and all(g[3] == 5 for g in got)
        cut = {r.doc_id: r.text for r in unit_dedup.without(docs, out).collect()}
        assert cut[6] == "" and cut[0] is None and cut[10].startswith("mail me")
        assert unit_dedup.removals(none, unit=unit).count() == 0


def test_units_local():
    units = lambda t, **k: [(t[a:b], n) for a, b, n in unit_dedup.units_of(t, 4, **k)]
    assert units("a b c d. E f.\ng\nh i j\n\nk") == [("a b c d.", b"a b c d."), ("a b c d. E f.", b"a b c d. e f."), ("g\nh i j", b"g\nh i j"), ("h i j\n\nk", b"h i j\nk")]
    assert units("A b\nc d\n\ne f\n \ng h i j\n", unit="paragraph") == [("A b\nc d", b"a b c d"), ("g h i j", b"g h i j")]
    assert units("") == units("\n. !") == []


def test_units_cut(spark):
    """Overlapping spans are cut once, whatever their order."""
    docs = spark.createDataFrame([(1, "0123456789\U0001f600x"), (2, "abc"), (None, "qrs")], "doc_id long, text string")
    gone = spark.createDataFrame([(1, 5, 7), (1, 1, 3), (1, 2, 4), (1, 2, 3), (1, 10, 11), (None, 0, 1), (2, 0, 3)], "doc_id long, start int, end int")
    assert {r.doc_id: r.text for r in unit_dedup.without(docs, gone).collect()} == {1: "04789x", 2: "", None: "rs"}


def test_units_passages():
    """A passage of 50 words is found in whatever text it stands, short sentences and short lines included."""
    rng = random.Random(6)
    say = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    for ends in ([" "], [".\n"], ["! "], [" ", ". ", "\n", "!! "]):
        shared = "".join(w + rng.choice(ends) for w in say(50))
        texts = ["".join(w + rng.choice(ends) for w in say(30)) + "\n" + shared + "\n" + " ".join(say(30)) for _ in range(2)]
        a, b = ({n for *_, n in unit_dedup.units_of(t)} for t in texts)
        assert a & b, ends


# --- op5 -----------------------------------------------------------------------------------


def sets_of(texts, k):
    out = []
    for t in texts:
        w = SPACE.findall(lower(t or ""))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def brute_components(texts, k, percent):
    s, parent = sets_of(texts, k), list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(s[a] & s[b])
        if both and 100 * both >= percent * (len(s[a]) + len(s[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return [(len(s[i]), find(i)) for i in range(len(texts))]


def near_copies(seed, sizes, edits):
    rng, out = random.Random(seed), []
    for n in sizes:
        base = [f"w{rng.randrange(400)}" for _ in range(n)]
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randrange(edits + 1)):
                w[rng.randrange(n)] = f"w{rng.randrange(400)}"
            if rng.random() < 0.3:
                w = w[: n - rng.randrange(1, 3)]
            out.append(" ".join(w))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("k", "percent", "light"), [(3, 90, None), (3, 90, 22), (5, 80, None), (5, 80, 9)])
def test_join(spark, written_docs, monkeypatch, k, percent, light):
    if light:
        monkeypatch.setattr(ngram_join, "boundary", lambda *_: light)
    texts = near_copies(7, [1, 2, 3, 5, 8, 11, 13, 16, 19, 21, 22, 24, 26, 29, 31, 40, 60, 150, 400], 3) + [None, "", "  ", "one", "One", "one  two"]
    d = spark.read.parquet(written_docs(texts) + "/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_components(d, k, percent).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, k, percent)


@pytest.mark.parametrize("percent", [80, 90])
def test_list_keys(percent):
    """Any two linked sets share a list, whatever their sizes and wherever they differ."""
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(400):
        n = int(rng.integers(5, 260))
        pool = rng.integers(1, 2**63, 2 * n + 40, dtype=np.uint64)
        m = int(rng.choice(list(ngram_join.partner_sizes(n, percent))))
        both = ngram_join.overlap_needed(n, m, percent)
        if not 0 < both <= min(n, m):
            continue
        a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:both], pool[n : n + m - both]]))
        x, y = (np.concatenate(ngram_join.list_keys(s, percent)) for s in (a, b))
        assert len(np.intersect1d(x, y)), (n, m)
        sizes = ngram_join.differences(n, percent), ngram_join.differences(m, percent)
        assert n + m - 2 * both <= min(sizes)


def test_join_tiles(spark, written_docs, monkeypatch):
    """Lists longer than a tile are cut; nothing is lost."""
    monkeypatch.setattr(ngram_join, "TILE", 5)
    texts = near_copies(3, [60] * 4, 4)
    d = spark.read.parquet(written_docs(texts) + "/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_components(d).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, 3, 90)


def test_join_repeated_id(spark):
    """Rows that share an id keep their own sets."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a), (5, b), (5, a), (7, a + " x"), (8, b + " x"), (9, "other " * 3 + b.upper())]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(5, 58, 5), (5, 58, 5), (5, 58, 5), (7, 59, 5), (8, 59, 5), (9, 61, 5)]


def test_join_odd(spark, docs, none):
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_shingles, r.component_id) for r in ngram_join.join_components(docs).collect())
    assert len(got) == docs.count() and [g[2] for g in got if g[0] in (-1, 5, 6, 7)] == [5] * 5
    assert [g for g in got if g[0] in (0, 1, 2)] == [(i, 0, i) for i in range(3)]
    assert ngram_join.join_components(none).count() == 0


# --- op6 -----------------------------------------------------------------------------------


def test_tokens(spark, written_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [None, "", "hello <|endoftext|> world", "é 日本 \U0001f600", "a " * 70_000] + [f"doc {i} it's 12 words!?\n\n  x" * (i % 7) for i in range(60)]
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.op6_seekable_tokens(spark, written_docs(texts)).collect()}
    lib, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        assert got[i] == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))), i
        at += len(ids)


@pytest.mark.parametrize("as_text", [False, True])
def test_pretokens(as_text):
    """Cutting here and encoding whole texts with the library give the same ids."""
    import public_tokenizers

    e = Encoder(public_tokenizers.path("byte_bpe_50k.json"), as_text)
    rng = random.Random(1)
    parts = [*"ab  \n\t'sstmdrevl12!?.é\xa0\x85\x1c\x1f\u2003\u2028ß²ªµ×'—…", "日", "'ll", "'re", "  ", "\r\n", "<|endoftext|>", "\U0001f600", "ǅ", "ɐ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(4000)] + [None, "", " " * 70_000]
    for t, ids in zip(texts, e(texts), strict=True):
        assert ids.tolist() == e.lib.encode(t or "", add_special_tokens=False).ids, t


def test_token_file(tmp_path):
    import zstandard

    path = tmp_path / "x.zst"
    docs = {i: [i % 50_000] * (i * 37 % 900) for i in range(500)}
    with path.open("wb") as f:
        w = token_files.Writer(f, 50_257, 4096)
        for i, ids in docs.items():
            w.add(i, ids)
        w.close()
    r = token_files.open_reader(f"file://{path}")
    assert {i: x.tolist() for i, x in r.rows()} == docs
    seen = []
    frame = r.frame
    r.frame = lambda k: seen.append(k) or frame(k)
    assert {i: x.tolist() for i, x in r.rows([3, 499])} == {i: docs[i] for i in (3, 499)} and len(seen) == 2
    whole = b"".join(struct.pack(f"<{len(v)}H", *v) for v in docs.values())
    with path.open("rb") as f:
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read(len(whole) + 1)[: len(whole)] == whole
    raw = bytearray(path.read_bytes())
    raw[40] ^= 1
    path.write_bytes(raw)
    with pytest.raises(Exception):  # noqa: B017
        list(token_files.open_reader(f"file://{path}").rows([0, 1, 2, 3]))


def test_tokens_odd(spark, docs, none, tmp_path):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    m = token_files.write_tokens(docs, f"file://{tmp_path}/t", path)
    got = token_files.scan_tokens(spark, m).collect()
    assert len(got) == docs.count() and min(got, key=lambda r: r.start).doc_id is None
    assert token_files.scan_tokens(spark, token_files.write_tokens(none, f"file://{tmp_path}/e", path)).count() == 0


# --- op7 -----------------------------------------------------------------------------------


def test_classifier(spark):
    got = {r.doc_id: r for r in QUERIES["op7_random_indexing"](spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in labels)
    held = [(got[r.doc_id].score, r.quality) for r in labels if got[r.doc_id].held_out]
    pos, neg = [s for s, q in held if q], [s for s, q in held if not q]
    assert sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())


def test_word_vectors(spark):
    """Context vectors and pooled features against plain loops."""
    import numpy as np

    from pixelframe.llm.shingles import word_hashes

    texts = ["a b c a b", "", "b c", "d", "a a a b"]
    q, d = quality_model, quality_model.DIMS
    hashes = {w: word_hashes([w.encode()], lower=False)[0] for w in "abcd"}
    bucket = {w: int(q._buckets(h)[0]) for w, h in hashes.items()}
    index = {}
    for w, h in hashes.items():
        place, sign = q.index_entries(h)
        index[w] = np.zeros(d)
        for j in range(2):
            index[w][place[j][0]] += sign[j][0]
    sums, n = {w: np.zeros(d) for w in "abcd"}, Counter()
    for t in texts:
        ws = t.split()
        for i, w in enumerate(ws):
            n[w] += 1
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(ws):
                    sums[w] += index[ws[j]]
    total = sum(n.values())
    mean = sum(sums.values()) / total
    unit = {w: (sums[w] - mean * n[w]) / max(1e-9, np.linalg.norm(sums[w] - mean * n[w])) for w in "abcd"}
    weight = {w: q.RARE / (q.RARE + n[w] / total) for w in "abcd"}
    vectors, weights = q.word_vectors(spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string").repartition(3))
    for w in "abcd":
        assert vectors[bucket[w]] == pytest.approx(unit[w], abs=1e-5) and weights[bucket[w]] == pytest.approx(weight[w])
    got = q.pooled([t.encode() for t in texts], vectors, weights)
    for t, x in zip(texts, got, strict=True):
        ws = t.split()
        if not ws:
            assert not x.any()
            continue
        own, mass = len(ws) / (len(ws) + q.PRIOR_WORDS), sum(weight[w] for w in ws)
        m = sum(weight[w] * unit[w] for w in ws) / mass
        s = sum(weight[w] * unit[w] ** 2 for w in ws) / mass
        assert x[:d] == pytest.approx(own * m, abs=1e-4)
        assert x[d : 2 * d] == pytest.approx(np.sqrt(own * np.maximum(0, s - m * m) + (1 - own) / d), abs=1e-3)
        pairs = list(itertools.pairwise(ws))
        assert x[2 * d :] == pytest.approx([math.log1p(len(ws)), own * sum(unit[a] @ unit[b] for a, b in pairs) / len(ws), own * sum(a == b for a, b in pairs) / len(ws)], abs=1e-4)


def test_labelled_sample(spark):
    """The documents with the least hashes, exactly; held-out ones, null labels and unknown ids never; repeated ids once."""
    hashes = sorted(r.h for r in spark.range(5000).selectExpr("xxhash64(id) h").collect())
    rows = spark.createDataFrame([(h,) for h in hashes], "h long")
    for limit in (0, 1, 7, 4999):
        top = quality_model.threshold(rows, limit)
        assert sum(h <= top for h in hashes) == limit
    assert quality_model.threshold(rows, 5000) is None and quality_model.threshold(rows.limit(0), 3) is None
    x = lambda i: struct.pack(f"<{quality_model.FEATURES}f", *[float(i or 0)] * quality_model.FEATURES)
    feats = spark.createDataFrame([(i, x(i)) for i in [*range(60), 3, None]], "doc_id long, x binary")
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(80), 3]] + [(90, None), (None, 1), (1, None)], "doc_id long, quality int")
    want = sorted(i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2)
    got, y = quality_model.labelled_sample(feats, labels)
    assert sorted(got[:, 0]) == want and all(a % 2 == b for a, b in zip(got[:, 0], y, strict=True))
    assert len(quality_model.labelled_sample(feats, labels, 10)[1]) == 10


def test_temperature():
    """The stored temperature has the least log loss of the grid on the part that was set aside."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, quality_model.FEATURES))
    y = (x[:, 0] + rng.normal(size=600) > 0).astype(float)
    net = quality_model.train(x, y)
    check = np.random.default_rng(7).permutation(600)[:120]
    z = net.logits(x[check])
    loss = lambda s: float(np.mean(np.logaddexp(0, -z / s) * y[check] + np.logaddexp(0, z / s) * (1 - y[check])))
    assert all(loss(net.temperature) <= loss(s) + 1e-12 for s in np.geomspace(0.25, 8, 41))


def test_classifier_odd(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(13)] + [(3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_model.classify(docs, labels).collect()
    assert len(got) == docs.count() and len({(round(r.score, 6), r.predicted) for r in got if r.doc_id in (None, 5, 6)}) == 1 and len({round(r.score, 6) for r in got if r.doc_id in (0, 1, 2)}) == 1
    assert {round(r.score, 6) for r in quality_model.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_model.classify(none, labels).count() == 0


# --- op8 -----------------------------------------------------------------------------------


def brute_rules(t):
    t = t or ""
    w = SPACE.findall(t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {g for g, c in Counter(grams).items() if c > 1}
    covered = {i + o for i, g in enumerate(grams) if g in twice for o in range(3)}
    lines = [x for x in t.split("\n") if SPACE.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("bits", [24, 2])
def test_rules(spark, written_docs, monkeypatch, bits):
    """With two position bits most texts take the exact path, and keys collide."""
    monkeypatch.setattr(quality_rules, "POSITION_BITS", bits)
    monkeypatch.setattr(quality_rules, "_LOW", (1 << bits) - 1)
    rng = random.Random(4)
    texts = [None, "", " \n ", "a\nb\na\n a\na"] + [" ".join(rng.choice("abc|d#") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 90))) for _ in range(80)]
    d = spark.read.parquet(written_docs(texts) + "/documents.parquet")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.ledger(d).collect()}
    assert got == {i: brute_rules(t) for i, t in enumerate(texts)}


def test_ledger(spark, docs, none):
    stored = quality_rules.stored_ledger(docs)
    rows = quality_rules.verdict(stored)
    got = rows.collect()
    assert all(r.decided_by is None if (bits := r.fail_bits & quality_rules.POLICIES[quality_rules.CURRENT]).bit_count() != 1 else bits == 1 << r.decided_by for r in got)
    assert quality_rules.ablations(stored.limit(0)).count() == 0
    twice = {r.bit: r for r in quality_rules.ablations(stored.union(stored)).collect()}
    assert all(twice[r.bit][2:] == tuple(2 * x for x in r[2:]) for r in quality_rules.ablations(stored).collect())
    assert len(got) == docs.count() and not any(r.kept for r in got if r.n_words < 50)
    abl = {r.rule: r for r in quality_rules.ablations(rows).collect()}
    few = sum(r.fail_bits & 1 for r in got)
    assert abl["few_words"].n_failed == few and abl["few_words"].n_failed_alone == sum(r.fail_bits & quality_rules.POLICIES[quality_rules.CURRENT] == 1 for r in got)
    assert quality_rules.ledger(none).count() == 0


# --- op9 -----------------------------------------------------------------------------------


def test_sharding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op9_virtual_slots"](spark, SF).collect()}
    for r in docs:
        raw = (r.text or "").encode()
        assert (got[r.doc_id].size, got[r.doc_id].text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    by, size = defaultdict(list), Counter()
    for r in got.values():
        by[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert set(by) == set(range(8)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(size.values()) - min(size.values()) <= max(r.size for r in got.values())


def test_slot_map():
    rng = random.Random(1)
    slots = [(s, rng.randrange(1, 1000), 1) for s in range(0, 2000, 2)]
    m = sharding.build_map(slots, 8, 2048)
    loads = m.loads(slots)
    assert max(loads) - min(loads) < 1000
    g = sharding.grow(m, slots)
    assert g.version == 2 and all(g.shard[s] in (m.shard[s], 8) for s, _, _ in slots) and max(g.loads(slots)) < 1.15 * sum(loads) / 9
    skew = [(s, b * (20 if m.shard[s] == 0 else 1), n) for s, b, n in slots]
    r = sharding.rebalance(m, skew, 0.02)
    assert max(r.loads(skew)) < 0.5 * max(m.loads(skew)) and 0 < len(r.moved) < 200 and r.version == 2


def test_stored_map(spark, docs, tmp_path):
    """A later run finds the newest map, edits it where the loads call for it and stores the next version."""
    path = f"file://{tmp_path}/map"
    assert sharding.newest_map(spark, path) is None
    first = {(r.doc_id, r.text_crc32): r.shard for r in sharding.shard(docs, 3, 64, path).collect()}
    one = sharding.newest_map(spark, path)
    assert (one.version, one.n_shards, len(one.shard)) == (1, 3, 64)
    again = {(r.doc_id, r.text_crc32): r.shard for r in sharding.shard(docs, 3, 64, path).collect()}
    kept = sharding.newest_map(spark, path)
    assert kept.version in (1, 2) and (kept.version == 2 or again == first)
    wide = sharding.shard(docs, 4, 64, path).collect()
    two = sharding.newest_map(spark, path)
    assert two.version == kept.version + 1 and two.n_shards == 4 and all(b in (a, 3) for a, b in zip(kept.shard, two.shard, strict=True))
    assert all(r.shard in (again[r.doc_id, r.text_crc32], 3) for r in wide)
    skew = docs.where("doc_id in (3, 4)").union(docs.where("doc_id = 12"))
    assert sharding.shard(skew, 4, 64, path).count() == 3
    slots = [(s, 10 + s, 1) for s in range(64)]
    assert sharding.edited(two, [], 4, 64) is two and len(sharding.edited(two, slots[:32], 4, 32).shard) == 32
    even = sharding.edited(sharding.build_map(slots, 4, 64), slots, 4, 64)
    assert even.version == 1


def test_half_written_map(spark, docs, tmp_path):
    """A version whose writer died is neither read nor in the way of the next one."""
    path = f"file://{tmp_path}/map"
    sharding.shard(docs, 3, 64, path).count()
    first = sharding.newest_map(spark, path)
    (tmp_path / "map" / f"map_version={first.version + 1}").mkdir()
    assert sharding.newest_map(spark, path) == first
    assert sharding.shard(docs, 4, 64, path).count() == docs.count()
    assert sharding.newest_map(spark, path).version == first.version + 2 and sharding.newest_map(spark, path).n_shards == 4
    assert sharding.shard(docs, 5, 64, path).count() == docs.count() and sharding.newest_map(spark, path).version == first.version + 3


def test_bytes_of_one_id(spark):
    """Many rows of one id don't outweigh a shard where records are placed by id and text."""
    rows = [(1, f"text {k} " + "x" * (k % 90)) for k in range(3000)] + [(k, "y" * 40) for k in range(300)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 4, by_text=True).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in got]
    assert len(sizes) == 4 and max(sizes) - min(sizes) < 0.02 * sum(sizes)


def test_sharding_groups(spark):
    """Rows with equal ids and texts, and rows without an id, each have a place of their own."""
    rows = [(1, "same")] * 5 + [(1, "other"), (None, "same"), (None, None), (2, None)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert len({(r.shard, r.slot) for r in got}) == len(rows) and len({r.shard for r in got if r.doc_id == 1}) == 1
    assert sorted(r["size"] for r in got) == [1, 1, 5, 5, 5, 5, 5, 5, 6]


def test_sharding_odd(spark, docs, none):
    got = sharding.shard(docs, 3).collect()
    assert len(got) == docs.count()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shard(none, 3).count() == 0


# --- op10 ----------------------------------------------------------------------------------


def brute_hits(text, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w, hit, found = word.findall(lower(text or "")), set(), set()
    for item, t in items:
        q = word.findall(lower(t or ""))
        n = min(len(q), 10)
        wins = {tuple(q[i : i + n]) for i in range(len(q) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_winnowing(spark, written_docs):
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(12)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.randrange(10, 40))) for i in range(12)] + [(20, None), (21, "..."), (22, "v1"), (23, say(4)), (24, say(9)), (25, say(10)), (26, "É v1 日本")]
    texts = [None, "", "v1", "V1!", "é v1 日本", "É V1 日本"]
    for _ in range(60):
        i = rng.choice(items)[1] or ""
        q = i.split()
        a = rng.randrange(max(1, len(q)))
        texts.append(say(rng.randrange(20)) + ", " + " ".join(q[a : a + rng.randrange(5, 16)]) + ". " + say(rng.randrange(20)))
    sf = written_docs(texts)
    spark.createDataFrame(items, "item_id long, text string").write.mode("overwrite").parquet(sf + "/benchmark.parquet")
    got = {r.doc_id: r for r in decontaminate.op10_winnowing(spark, sf).collect()}
    for i, t in enumerate(texts):
        n, h, found = brute_hits(t, items)
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].contaminated) == (n, h, len(found), h > 0), t
        assert got[i].items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_winnowing_guarantee(spark):
    """Any shared span of ten words keeps a common fingerprint."""
    rng = random.Random(3)
    span = [f"s{rng.randrange(30)}" for _ in range(10)]
    sides = [(i, [f"a{rng.randrange(9)}" for _ in range(rng.randrange(30))] + span + [f"b{rng.randrange(9)}" for _ in range(rng.randrange(30))]) for i in range(40)]
    got = decontaminate.with_fingerprints(spark.createDataFrame(sides, "i long, w array<string>")).collect()
    prints = [{p >> decontaminate.POSITION_BITS for p in r.prints} for r in got]
    assert all(a & b for a, b in itertools.combinations(prints, 2))


def test_winnowing_odd(spark, docs, none):
    items = spark.createDataFrame([(1, " ".join(TEXT.split()[3:20])), (1, "lazy"), (None, "fox")], "item_id long, text string")
    bad = decontaminate.contamination(docs, items).collect()
    assert {r.doc_id for r in bad} == {5, 6, 7, 8, None}
    assert decontaminate.contamination(docs, items.limit(0)).count() == 0 and decontaminate.contamination(none, items).count() == 0


TEXT = "the quick brown fox jumps over the lazy dog and then it sleeps for a very long while under the old tree by the river where nobody ever goes at night because it is dark"


# --- pipeline ------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = stage["quality_rules"](spark, docs, SF)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    want = {r[list(duck(ORACLE_SQL["op8_rule_ledger"])[0]).index("doc_id")] for r in duck(ORACLE_SQL["op8_rule_ledger"])[1] if r[list(duck(ORACLE_SQL["op8_rule_ledger"])[0]).index("kept")]}
    assert ids == want and kept.columns == docs.columns
    order = sorted(ids)
    comp = brute_components([texts[i] for i in order], 5, 80)
    unique = {i for k, i in enumerate(order) if comp[k][1] == k}
    clean = {i for i in unique if not brute_hits(texts[i], items)[1]}
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(out) == clean and all(r.decodes for r in out.values())


def test_clear(spark):
    from pixelframe.llm import common

    df = common.written(spark.range(3), "x")
    path = common._MADE[-1]
    assert df.count() == 3
    common._MADE[:] = [path]
    common.clear(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_stages_odd(spark, docs, none):
    """Every stage takes nulls, empty and long texts, repeated rows, extra columns and empty tables."""
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() <= docs.count() and stage(spark, none, SF).count() == 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    ids = sorted(r.doc_id if r.doc_id is not None else -1 for r in dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, docs, SF).collect())
    assert {0, 1, 2, 3, 4, 5, 9, 10, 11, 12} <= set(ids) and not {6, 7} & set(ids) and ids.count(5) == 1


def test_chunks_are_solved_once(monkeypatch):
    """Later runs of texts solve only chunks that no earlier one held, and give what a fresh start gives, also when a full memory is dropped."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    runs = [["the old mill by the river", "", "x" * 200], ["the old river mill \U0001f600", "by the by", "x" * 200], ["the mill", "naïve café", "x" * 199]]
    plain = lambda got: [([x.tolist() for x in lists], scores) for lists, scores in got]
    fresh = [plain(nbest.Segmenter(path, 4)(r)) for r in runs]
    sizes, solve = [], nbest.Batch._group
    monkeypatch.setattr(nbest.Batch, "_group", lambda self, us, size: sizes.append(len(us)) or solve(self, us, size))
    seg = nbest.Segmenter(path, 4)
    assert [plain(seg(r)) for r in runs] == fresh
    assert len(seg.solved.keys) == len(set(seg.solved.keys.tolist()))
    before = sum(sizes)
    assert [plain(seg(r)) for r in runs] == fresh and sum(sizes) == before
    monkeypatch.setattr(nbest, "KEPT", 2)
    assert [plain(seg(r)) for r in runs] == fresh and sum(sizes) > before
    assert nbest.segmenter(path, 4) is nbest.segmenter(path, 4)
