"""The alignment of two tokenizers against a plain version that looks at the
owners of every byte of a document."""

import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from boreframe.llm.queries import QUERIES
from boreframe.llm.token_alignment import align_tokenizers
from tests.conftest import SF_SMALL

SCHEMA = "doc_id long, text string, unit int, id string"


def byte_table() -> dict:
    """Characters of the byte-level vocabulary to bytes (the printable ones stand
    for themselves, the others follow from 256 on)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def tokens(texts):
    """Per text: two lists of (id, bytes), or None."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    table = byte_table()
    for t in texts:
        if not t:
            yield None
            continue
        xs = [(i, bytes(table[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids]
        ys = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
              for i in b.encode(t) for p in [b.id_to_piece(i)]]
        want = (" " + t).encode()
        yield (xs, ys) if b"".join(x for _, x in xs) == want == b"".join(y for _, y in ys) else None


def spans(toks):
    out, at = [], 0
    for i, x in toks:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def plain(rows):
    """(doc_id, text) rows to the contract's rows: two tokens are linked if they
    share a byte, and a byte that ends a token of both ends a group."""
    links, docs = Counter(), []
    for (doc, _), got in zip(rows, tokens([t for _, t in rows])):
        if got is None:
            docs.append((doc, 0, 0, 0, [], ""))
            continue
        xs, ys = map(spans, got)
        owners = list(zip(*([n for n, (_, p, q) in enumerate(side) for _ in range(p, q)] for side in (xs, ys))))
        mine = [(xs[m][0], ys[n][0]) for m, n in sorted(set(owners))]
        links.update(mine)
        text, group_a, group_b = [], [], []
        for at, (m, n) in enumerate(owners):
            ends_a, ends_b = xs[m][2] == at + 1, ys[n][2] == at + 1
            group_a += [str(xs[m][0])] * ends_a
            group_b += [str(ys[n][0])] * ends_b
            if ends_a and ends_b:
                text.append(",".join(group_a) + "|" + ",".join(group_b))
                group_a, group_b = [], []
        docs.append((doc, len(xs), len(ys), len(text), mine, ";".join(text)))
    top = Counter()
    for (_, b), n in links.items():
        top[b] = max(top[b], n)
    return sorted(((d, na, nb, ng, len(m), sum(links[x] == top[x[1]] for x in m), sum(links[x] for x in m),
                    hashlib.sha256(g.encode()).hexdigest() if na else "") for d, na, nb, ng, m, g in docs), key=order), links, top


COLS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def order(r):
    return r[0] is not None, r


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLS).collect()), key=order)


def test_alignment_against_every_byte(spark):
    texts = ["The quick  brown fox", "", None, "a▁b", " leading and trailing ", "tabs\tand\n\nlines", "naïve café 日本語",
             "<|endoftext|> <s> </s> <unk> <0x41>", "x" * 300, " nbsp 　 wide", "antidisestablishmentarianism 1234567",
             "\U0001f600 emoji ́ mark", "a\x00b", "The quick  brown fox", "   ", "ภาษาไทย" * 20]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    want, links, top = plain(rows)
    got, pairs = align_tokenizers(df, unit_chars=60)  # several units
    assert rows_of(got) == want
    table = {(r["a_id"], r["b_id"]): (r["count"], r["best"]) for r in pairs.collect()}
    assert table == {p: (n, n == top[p[1]]) for p, n in links.items()}


def test_alignment_of_repeated_and_null_ids_and_kept_groups(spark):
    df = spark.createDataFrame([(7, "one two", 1, "x"), (7, "one two", 2, "y"), (None, "three", 3, "z"), (7, "four", 1, "x")], SCHEMA)
    got, _ = align_tokenizers(df, keep_groups=True)
    rows = got.orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == [None, 7, 7, 7]
    assert all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] and
               r["groups"].count(";") + 1 == r["n_groups"] for r in rows)
    assert align_tokenizers(df.limit(0))[0].count() == 0


def test_query_on_whole_table_against_every_byte(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert rows_of(QUERIES["op12_token_alignment"](spark, SF_SMALL)) == plain(docs)[0]
