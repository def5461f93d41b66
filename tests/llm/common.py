"""Messy small tables and plain reference versions of the operators."""

import random
import re

import public_tokenizers

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, slot int, score string, ids string, kept string, block string"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def words(text):
    return WORD.findall(lower(text or ""))


def sentence(rng, n):
    return " ".join(rng.choice(["the", "of", "stone", "river", "night", "walk", "blue", "éte", "grün", "house", "open", "7", "paper", "light."]) + rng.choice(["", "", "", "s", "ing", "er"]) for _ in range(n))


def messy(seed=0, n=40):
    """Texts with copies, near copies, nulls, blanks, odd characters and a very long one."""
    rng = random.Random(seed)
    base = [sentence(rng, rng.randint(60, 120)) for _ in range(8)]
    texts = [None, "", " \n\t ", "one", "Two words", "a b c d", "a b c d", "A B C D e", "  lead and  double  spaces ", "tab\tand\vnl\x85nbsp\xa0x", "</s> <s> ▁ <|endoftext|> \\### x", "日本語 テキスト 😀", "\x00 zero", "=" * 3000]
    for i in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = "changed%d" % rng.randrange(5)
        cut = rng.randrange(10, len(w))
        texts.append(" ".join(w[:cut]) + "\n" + " ".join(w[cut:]))
    texts.append(" ".join(base) * 60)
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rows += [rows[20], (rows[21][0], rows[21][1]), (None, "a row without an id " * 6), (None, None)]
    return rows


def frame(spark, rows):
    """``rows`` of (doc_id, text) with the other columns of documents and extra columns whose names operators use too."""
    full = [(i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else f"s{k % 3 if k % 2 else 0}", None if t is None else len(t), "x", 1, "y", "z", "k", "b") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOCS).repartition(3)
