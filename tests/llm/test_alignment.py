import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from codecorpus.llm import alignment as A
from llm_fixtures import edge_docs, no_docs  # noqa: F401

SF = "/root/testdata/sf0.001"
ODD = ["<|endoftext|> is text", "a  b   c\t\n d", "▁ marks", "emoji 👩‍👩‍👧 ok", "<0x0A> <s> </s> <unk>", " leading", "trailing ",
       " nbsp", "日本語テキスト", "ΑΒΓ ᾳ", "\x00null", "é combining", "x" * 5000, "\n\n\n", "½ ﬁ ™"]


def _brute(texts):
    """Token by token, with a dictionary of end offsets."""
    import public_tokenizers as P
    import sentencepiece
    a_tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(keep)))}
    docs = []
    for text in texts:
        a = a_tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_tok.encode(text) if text else []
        sa = [bytes(byte_of[c] for c in a_tok.id_to_token(i)) for i in a]
        sb = [bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode()
              for i, p in ((i, b_tok.id_to_piece(i)) for i in b)]
        if not text or not (b"".join(sa) == b"".join(sb) == (" " + text).encode()):
            docs.append(([], [], [], ""))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in sa]).tolist(), np.cumsum([len(x) for x in sb]).tolist()
        links = [(a[i], b[ends_b.index(e)]) for i, e in enumerate(ends_a) if e in set(ends_b)]
        groups, i, j = [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            p, q = ends_a.index(e) + 1, ends_b.index(e) + 1
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            i, j = p, q
        docs.append((a, b, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(x for d in docs for x in d[2])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    return [(len(a), len(b), len(x), len(x), sum(count[p] == most[p[1]] for p in x), sum(count[p] for p in x), h)
            for a, b, x, h in docs]


@pytest.mark.parametrize("broadcast_pairs", [A.BROADCAST_PAIRS, 0])
def test_matches_brute_force(spark, broadcast_pairs):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ODD + ["", None] + ODD[:3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in A.alignment(df, broadcast_pairs=broadcast_pairs).collect()}
    want = dict(enumerate(_brute(texts)))
    assert {i for i in got if got[i] != want[i]} == set() and len(got) == len(want)


def test_edges(edge_docs, no_docs):
    rows = A.alignment(edge_docs).collect()
    assert len(rows) == 13 and A.alignment(no_docs).collect() == []
    by_id = {r["doc_id"]: r for r in rows}
    for i in (1, 2, 11):
        assert tuple(by_id[i])[1:] == (0, 0, 0, 0, 0, 0, "")
    assert by_id[4]["n_groups"] > 60_000 and by_id[8]["groups_sha256"] == by_id[9]["groups_sha256"]


@pytest.mark.parametrize("lane", [1, 3, 1000])
def test_lanes_do_not_change_links(lane):
    rng = random.Random(lane)
    size_a, size_b = np.array([1, 2, 3, 5]), np.array([1, 2, 4, 7])

    def row(sizes, total):
        out = []
        while total:
            i = rng.choice([k for k in range(4) if sizes[k] <= total])
            out.append(i)
            total -= int(sizes[i])
        return out
    totals = [0, 1, 40, 7, 300, 0, 13]
    rows_a, rows_b = [row(size_a, t) for t in totals], [row(size_b, t) for t in totals]
    a, b, at_a, at_b = A.align(rows_a, rows_b, size_a, size_b, lane)
    ends_a, ends_b = np.cumsum(size_a[a[0]]), np.cumsum(size_b[b[0]])
    both = np.intersect1d(ends_a, ends_b)
    assert ends_a[at_a].tolist() == ends_b[at_b].tolist() == both.tolist()


def test_every_id_has_bytes():
    """A token without bytes would end where its neighbour ends."""
    t = A.Tokenizers(*A.default_files())
    assert (t.a_size > 0).all() and (t.b_size > 0).all()
