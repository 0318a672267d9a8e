import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from tessel.llm import filter_audit

from .helpers import AWKWARD, corpus


def failing(rows):
    """The filters that each row fails, one row at a time."""
    out = []
    for i, text, _ in rows:
        text = text or ""
        words = [w for w in re.split("[ \\t\\n\\x0b\\x0c\\r]+", text) if w]
        own = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
        own += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text)) + "D" * bool(set(text) & set("#$%&*|"))
        key = lambda x: 2**63 - 1 if x is None else x
        out.append(own + "E" * any((t or "") == text and key(j) < key(i) for j, t, _ in rows))
    return out


def plain_audit(rows, good, toxic):
    """Every order applied to every row, step by step."""
    fails, out, removed_by = failing(rows), {}, {}
    parts = {part or "" for _, _, part in rows}
    for order in map("".join, permutations("ABCDE")):
        left = list(range(len(rows)))
        for step, f in enumerate(order, 1):
            here = [k for k in left if f in fails[k]]
            left = [k for k in left if f not in fails[k]]
            for part in parts:
                own = lambda ks: [k for k in ks if (rows[k][2] or "") == part]  # noqa: B023, E731
                gone = [k for k in own(range(len(rows))) if f in fails[k] and k not in here and k not in left]
                out[part, order, step] = [
                    len(own(left)), len(own(here)), len(gone), sum(fails[k] == f for k in own(range(len(rows)))),
                    sum(rows[k][0] in good for k in own(here)), sum(rows[k][0] in toxic for k in own(here)),
                ]
                removed_by[part, f] = removed_by.get((part, f), 0) + len(own(here))
    return {(part, order, step): (*x, removed_by[part, order[step - 1]]) for (part, order, step), x in out.items()}


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, lang string, mask string, n int, `a.b` string")


def made(seed):
    rng = random.Random(seed)
    rows = [(i, t, rng.choice(["en", "de", None])) for i, t in corpus(seed, 25, 15)]
    rows += [(100 + k, f"copy {'LOUD ' * 9}", rng.choice(["en", None])) for k in range(20)]  # a hot text in two parts
    rows += [(200, "word " * 300, "en"), (201, " ".join(f"w{k}" for k in range(50_000)), "de"), (202, "A\u00a0B | C", "en")]
    return rows + [(i, t, "en") for i, t in AWKWARD]


def test_the_audit_equals_applying_every_order(spark):
    rows = made(3)
    labels = [(i, 1, 0) for i in range(0, 12)] + [(i, 0, 1) for i in range(8, 20)] + [(105, 1, 1), (105, 0, 0), (None, 1, 1), (5, None, 1), (999, 1, 1)]
    got = filter_audit.audit(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = plain_audit(rows, {i for i, g, _ in labels if g and i is not None}, {i for i, _, t in labels if t and i is not None})
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}
    assert len(got) == len(want) == 3 * 120 * 5 and found == want


def test_cells_come_back_exactly_from_their_parity_sums(spark):
    rng = random.Random(1)
    counts = [rng.choice([0, 1, 7, 10**15 + 3]) for _ in range(32)]
    counted = spark.createDataFrame([("p", 0, m, n) for m, n in enumerate(counts) if n], "part string, flags int, mask int, n long")
    row = filter_audit.parity_sums(counted, 5).select("sums", filter_audit.cells(F.col("sums"), 5).alias("cells")).first()
    assert row.cells == counts
    assert row.sums == [sum(n * (-1) ** (m & s).bit_count() for m, n in enumerate(counts)) for s in range(32)]


def test_no_documents_and_other_names(spark):
    rows = table(spark, made(4)).withColumnsRenamed({"doc_id": "doc.id", "text": "the text", "lang": "id"})
    labels = spark.createDataFrame([], "`doc.id` long, q int, t int")
    names = {"id_col": "doc.id", "text_col": "the text", "part_col": "id", "good": "q", "toxic": "t"}
    assert filter_audit.audit(rows, labels, **names).count() == 3 * 120 * 5
    assert filter_audit.audit(rows.limit(0), labels, **names).count() == 0
