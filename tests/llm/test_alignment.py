import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tapeloom.llm import alignment

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def _letters():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(rest)}


def _plain(texts):
    """Whole texts, token bytes alone, every pair of tokens compared."""
    a, b, letters = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), _letters()
    a.encode_special_tokens = True
    rows, counts = [], Counter()
    for t in texts:
        links, groups = [], ""
        a_ids = a.encode(" " + (t or ""), add_special_tokens=False).ids
        b_ids = b.encode(t or "")
        a_tokens = [bytes(letters[c] for c in a.id_to_token(i)) for i in a_ids]
        b_tokens = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in b_ids)]
        if t and b"".join(a_tokens) == b"".join(b_tokens) == (" " + t).encode():
            spans = [[(sum(map(len, x[:k])), sum(map(len, x[: k + 1]))) for k in range(len(x))] for x in (a_tokens, b_tokens)]
            links = [(a_ids[i], b_ids[j]) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e]
            both = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
            parts = []
            for lo, hi in zip([0, *both], both):
                parts.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, sp) if lo <= s and e <= hi) for ids, sp in zip((a_ids, b_ids), spans)))
            groups = ";".join(parts)
        else:
            a_ids, b_ids = [], []
        counts.update(links)
        rows.append((len(a_ids), len(b_ids), groups.count("|"), links, groups))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(x, y, g, len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(s.encode()).hexdigest() if s else "", s) for x, y, g, links, s in rows]


def _texts():
    rng = random.Random(5)
    bits = ["the", "Quick", "naïve", "éè", "\U0001f600\U0001f601", "你好龘", "क्ष", "it's", "1234", "  ", "\n", "\n\n", "\t", " ", "　", "...", "<s>", "</s>", "<|endoftext|>", "<0x41>", "\x00", "é", "ﬁ", "\r\n", "zxqj", "​", "᠎"]
    made = [rng.choice(["", " "]).join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(250)]
    made += ["".join(rng.choice(["ab", "É", "x", "'", "s", "ll", ".", "\n", " ", "  ", "#", "7", "²", "ß", "'s", "\t", "-", "_", "K", "ñ", "“"]) for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    made += [" ".join(rng.choice(bits) for _ in range(20)) for _ in range(60)]
    return [None, "", " ", "  ", "a", " a", "a ", "x▁y", "▁", "plain words, plain words.", "plain words, plain words.", *made]


@pytest.mark.parametrize("most_pairs", [1 << 20, 0])
def test_every_column_against_all_pairs(spark, most_pairs):
    texts = _texts()
    rows = [(i, t, "n", 1, 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, groups string, a int, n int").repartition(5)
    got = sorted(alignment.align(docs, A, B, with_groups=True, most_pairs=most_pairs).collect())
    want = _plain(texts)
    assert [tuple(r)[1:] for r in got] == want
    assert any(w[6] == "" and t for w, t in zip(want, texts)) and sum(w[3] > 0 for w in want) > 250


def test_chunks_are_encoded_as_in_their_text():
    aligner = alignment.Aligner(A, B)
    assert aligner.cuts
    for t in filter(None, _texts()):
        assert "".join(aligner.chunks(t)) == " " + t
        whole, parts = aligner.align([" " + t])[0], aligner.align(aligner.chunks(t))
        assert (whole is None) == (None in parts)
        if whole:
            assert whole[4] == ";".join(p[4] for p in parts)


def test_long_texts_null_ids_repeated_rows_and_an_empty_table(spark):
    long, glued = "word " * 60_000, "aé" * 20_000
    docs = spark.createDataFrame([(None, long), (1, glued), (1, glued), (2, "word")], "doc_id long, text string")
    got = {r.doc_id: r for r in alignment.align(docs, A, B).collect()}
    assert got[None].n_groups >= 60_000 and got[2].n_groups == 1
    assert got[2].count_sum >= got[2].n_best >= 1
    assert alignment.align(docs, A, B).count() == 4
    none = alignment.align(docs.filter("doc_id > 9"), A, B)
    assert none.count() == 0 and "groups" not in none.columns


def test_spans_are_refined_by_bytes():
    tokens = [b" a", b"\xf0\x9f", b"\x98\x80", b" ", b"b"]
    assert alignment.byte_ends([(0, 2), (2, 6), (2, 6), (7, 7), (7, 8)], tokens) == [2, 4, 6, 7, 8]
    cuts, links = alignment.groups_and_links([2, 4, 6, 7, 8], [3, 6, 8])
    assert cuts == [(3, 2), (5, 3)] and links == [(0, 0), (1, 0), (1, 1), (2, 1), (3, 2), (4, 2)]
