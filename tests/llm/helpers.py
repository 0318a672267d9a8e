import random

AWKWARD = [(1, None), (2, ""), (3, "   \n \n"), (None, "a line that has no id at all"), (4, "x" * 3000), (5, "same same"), (5, "same same"), (5, "other text"), (6, "é" * 60)]


def docs(spark, rows, more=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + more)


def awkward(spark):
    """Nulls, empty and blank texts, a long text, repeated rows, and columns named like the operators' own."""
    rows = [(i, t, "k", 1, 2, "r") for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, k1 string, pos int, id long, row string")


def sentence(rng, n):
    return " ".join(rng.choice(["red", "blue", "iron", "oak", "river", "stone", "lamp", "wind", "Fox", "sea"]) + str(rng.randrange(9)) for _ in range(n))


def corpus(seed, n=60, copies=20):
    """Texts with exact and near copies, shared passages and repeated lines."""
    rng = random.Random(seed)
    passage = ". ".join(sentence(rng, 8) for _ in range(6)) + "."
    texts = []
    for _ in range(n):
        lines = [". ".join(sentence(rng, rng.randrange(3, 9)) for _ in range(rng.randrange(1, 5))) + "." for _ in range(rng.randrange(1, 6))]
        if rng.random() < 0.3:
            lines.insert(rng.randrange(len(lines) + 1), passage)
        texts.append("\n".join(lines))
    for _ in range(copies):
        words = rng.choice(texts[:n]).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(len(words))] = f"new{rng.randrange(99)}"
        texts.append(" ".join(words))
    rng.shuffle(texts)
    return list(enumerate(texts))
