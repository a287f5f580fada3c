"""Rows with nulls, repeats, long texts, odd characters and clashing columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, pos int, key string, node long, pack int, score double, bucket string, _all string, stratum string"
LABELS = "doc_id long, quality int, toxic int, text string"
BENCHMARK = "item_id long, text string, doc_id long"
TALKS = "conv_id long, turn long, role string, text string, node long, tree string"


def _text(seed: int, n: int) -> str:
    g = random.Random(seed)
    words = "the of and to in on that river stone garden under light morning window paper silver" .split()
    return " ".join(g.choice(words) + g.choice(["", "", "", ".", ","]) for _ in range(n))


def odd_documents() -> list[tuple]:
    shared = "this very line stands in several documents"
    base = _text(1, 300)
    texts = [
        (1, base), (1, base), (2, base + " more words here"), (3, None), (4, ""), (None, "no id here " + _text(2, 40)), (None, None), (5, _text(3, 60_000)),
        (6, f"{shared}\nown one\n{shared}"), (7, f"  {shared.upper()}\t\nown two"), (8, f"x\n{shared}"), (9, shared), (10, "a  b\n\n c\t\u00a0d\x1c e\x85"), (11, "\n"), (12, " "),
        (13, "<|endoftext|> and\x01 'tis don't"), (14, "éÀ ß\u0130 \u212b e\u0301"), (15, "api_key = 'abcdef123' token: x"), (16, "1 2 3 4 5 6 7 8 9 10 11 12"), (2**62, "large id"), (-5, "negative id"),
        (17, "word " * 500), (18, "w" * 100_000), (19, base), (19, "same id, other text " + _text(9, 50)),
    ]
    return [(i, t, [None, "en", "fr"][k % 3], [None, "a", "b", "c"][k % 4], None if t is None else len(t), 1, 2, "k", 3, 4, 0.5, "b", "all", "s") for k, (i, t) in enumerate(texts)]
