import random

from tokenizers import Tokenizer

from kervan.llm import tokens

ALPHABET = ["a", "the ", " ", "  ", "\n", "ş", "🙏", "水", "don't", "12", "..", "<|endoftext|>", "x" * 7, "'s", "\n\n", "A", "的"]


def reference():
    t = Tokenizer.from_file(f"{tokens.FOLDER}/{tokens.NAME}.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_tree_is_exact():
    rng, enc = random.Random(3), tokens.encoder()
    for k in range(1500):
        s = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(1, 300))) if k % 3 else "".join(rng.choice("abcdeş水") for _ in range(rng.randrange(1, 400)))
        n = rng.choice([2, 4, 8])
        at = [len(s) * i // n for i in range(n + 1)]
        assert tokens.tree(enc, [enc.encode_ordinary(s[at[i] : at[i + 1]]) for i in range(n)]) == enc.encode_ordinary(s)


def test_texts(spark):
    ref, rng = reference(), random.Random(4)
    texts = ["", None, " ", "<|endoftext|>", "abc " * 2000, "ş" * 3000] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 900))) for _ in range(30)]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    for part in (tokens.PART, 257, 40):
        got = {r.doc_id: list(r.ids) for r in tokens.encode_texts(df, "doc_id", "text", part=part).collect()}
        assert got == {i: ref(t) if t else [] for i, t in enumerate(texts)}
    twice = spark.createDataFrame([(None, "abc ş " * 200), (None, "abc ş " * 200), (3, "x" * 999)], "doc_id long, text string")  # null keys, repeated rows
    got = tokens.encode_texts(twice, "doc_id", "text", part=100).collect()
    assert sorted((r.doc_id or 0, list(r.ids)) for r in got) == sorted([(0, ref("abc ş " * 200))] * 2 + [(3, ref("x" * 999))])
    assert tokens.encode_texts(df.limit(0), "doc_id", "text").count() == 0
