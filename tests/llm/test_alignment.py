"""Alignments against the two libraries on whole texts, and the laws of the fragment monoid."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from churnscope.llm import alignment
from churnscope.llm.bpe import byte_chars
from tests.llm.conftest import DOCS

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte_of = {c: k for k, c in enumerate(byte_chars())}

    def of(text):
        """(ids, token bytes) of both, or None."""
        if not text:
            return None
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        pieces = [b.id_to_piece(i) for i in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces)]
        whole = (" " + text).encode()
        return (list(zip(ids_a, bytes_a)), list(zip(ids_b, bytes_b))) if b"".join(bytes_a) == whole == b"".join(bytes_b) else None

    return of


def spans(tokens):
    at = 0
    for i, x in tokens:
        yield i, at, at + len(x)
        at += len(x)


def plain_rows(rows, of):
    """All rows by definition: pairs of spans that overlap, groups between common ends."""
    found, counts = [], Counter()
    for doc_id, text in rows:
        streams = of(text)
        if streams is None:
            found.append((doc_id, 0, 0, [], [], ""))
            continue
        a, b = (list(spans(t)) for t in streams)
        links, k = [], 0
        for i, s, e in a:
            while k and b[k][1] > s:
                k -= 1
            while k < len(b) and b[k][2] <= s:
                k += 1
            j = k
            while j < len(b) and b[j][1] < e:
                links.append((i, b[j][0]))
                j += 1
        groups, one = [], ([], [])
        ends_a, ends_b = {e for _, _, e in a}, {e for _, _, e in b}
        for e in sorted(ends_a | ends_b):
            one[0].extend(str(i) for i, _, x in a if x == e) if len(a) < 200 else one[0].extend(by_end(a)[e])
            one[1].extend(str(i) for i, _, x in b if x == e) if len(b) < 200 else one[1].extend(by_end(b)[e])
            if e in ends_a and e in ends_b:
                groups.append(",".join(one[0]) + "|" + ",".join(one[1]))
                one = ([], [])
        counts.update(set(links))
        found.append((doc_id, len(a), len(b), groups, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    return sorted(((d, n_a, n_b, len(g), len(x), sum(counts[p] == best[p[0]] for p in x), sum(counts[p] for p in x), h) for d, n_a, n_b, g, x, h in found), key=str)


_BY_END = {}


def by_end(stream):
    key = id(stream)
    if key not in _BY_END:
        _BY_END.clear() if len(_BY_END) > 1 else None
        held = defaultdict(list)
        for i, _, e in stream:
            held[e].append(str(i))
        _BY_END[key] = (stream, held)
    return _BY_END[key][1]


def odd_texts():
    r = random.Random(5)
    bits = ["word", "Ünï", "漢字", "🙂", "don't", "x1.5", " ", "  ", "\n", "\t", " ", "▁", "　", "<|endoftext|>", "<s>", "\x1c", "\x00", "▁▁", "...", " \n ", "é" * 5]
    out = ["".join(r.choice(bits) + r.choice(["", " ", " "]) for _ in range(r.randrange(1, 30))) for _ in range(120)]
    return out + ["漢字" * 9000, "ab" * 20000, " lead", "trail ", " ", "▁", "a▁ b", "x  y   z", "word " * 3000 + "end"]


def rows_of(df):
    return sorted((tuple(x) for x in df.collect()), key=str)


@pytest.mark.parametrize("chunk,broadcast", [(alignment.CHUNK, 10**6), (40, 0)])
def test_against_the_libraries(spark, docs, plain, chunk, broadcast):
    """Whole documents and the broadcast table; then chunks of 40 characters, several levels of reductions, and the join."""
    rows = [(d["doc_id"], d["text"]) for d in docs.collect()] + [(100 + k, t) for k, t in enumerate(odd_texts())]
    if chunk == 40:
        rows = [(i, t) for i, t in rows if len(t or "") < 20000]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).withColumnRenamed("lang", "row").withColumnRenamed("source", "pairs").repartition(3)
    assert rows_of(alignment.align(df, A, B, chunk, broadcast)) == plain_rows(rows, plain)


def test_registered_query(spark, stored, plain):
    full, empty = stored
    rows = [(d["doc_id"], d["text"]) for d in spark.read.parquet(full + "/documents.parquet").collect()]
    assert rows_of(alignment.op13_alignment(spark, full)) == plain_rows(rows, plain)
    assert alignment.op13_alignment(spark, empty).count() == 0


def test_fragments_are_a_monoid(plain):
    """Any cutting into byte ranges and any bracketing give the same fragment; the empty one is the unit."""
    r = random.Random(6)
    for text in odd_texts()[:60]:
        streams = plain(text)
        if streams is None:
            continue
        a, b = (alignment.Tokens([i for i, _ in s], [len(x) for _, x in s]) for s in streams)
        want = alignment.compose([alignment.START, alignment.stretch(a, b)])
        for size in (1, 2, 3, 7, 50):
            parts = [alignment.START, *alignment.byte_ranges(a, b, size)]
            assert alignment.compose(parts) == want
            while len(parts) > 1:
                k = r.randrange(len(parts) - 1)
                parts[k : k + 2] = [alignment.compose(parts[k : k + 2])]
            assert parts[0] == want == alignment.compose([alignment.Fragment(), want, alignment.Fragment()])


def test_table_of_stretches_is_bounded(monkeypatch):
    monkeypatch.setattr(alignment, "WORD_BYTES", 100_000)
    at = alignment.Aligner(A, B)
    for k in range(3000):
        at.align_all([f"w{k} 漢{k}字 common"])
        assert len(at.kept) < 300 and at.size < 110_000
    at.align_all(["漢字" * 5000])
    assert all(len(k) <= alignment.WORD_LENGTH for k in at.kept)
