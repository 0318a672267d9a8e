"""N-gram Jaccard join by parity sketches: which documents' shingle sets are so similar that they link.

Documents link when |A n B| * DEN >= NUM * |A u B|.  Then |A ^ B| <= (DEN - NUM) / (DEN + NUM) * (|A| + |B|), and sizes
differ by a factor of NUM / DEN at most.

1. Size bands grow by DEN / NUM, and a set takes part in its own band and the next, so linked sets share a band.  All sets
   of a band have at most ``d`` differences to what they link with.
2. A band's sketch has ``k = d + 1 + slack`` words.  Each shingle falls to one word and is XORed into it, so a difference
   changes one word at most: the words that differ, like the Hamming distance of one-bit words, are a lower bound of
   |A ^ B|.  By the pigeonhole principle at least slack + 1 words of linked sets are equal.
3. So each set may leave out ``slack`` words and still meets every set that it links with, as long as all leave out by
   one order: words without a shingle first, then the most frequent.  Hot words, such as those of a passage that
   a third of all documents share, drop out like that.
4. Sets that share a word left in are candidates.  Each is compared by its members with the smallest one of each of its
   words first, and what links forms components.  Words whose sets are in one component by then are done.
5. Components that the others connect are compared with each other, in chunks of bounded size, where parity bits (again a
   lower bound) leave few pairs to be compared by members.  Only links that join two components leave a task.  A word of
   two sets is always done by then, so a chain of accidental pairs connects nothing.

Equal sets are one class from the start.  Texts are shuffled once, into blocks (see blocks.py).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.blocks import MESSAGE, Block, heads_of, into_blocks, layout, messages, short
from tessel.llm.common import field, join_counted, keep, pack, ship
from tessel.llm.components import connected_components
from tessel.llm.line_dedup import BLANKS
from tessel.llm.shingles import Sets, parity_bits, set_hashes, shingle_sets
from tessel.llm.text_arrays import U, mix, slices, trim

SIZE, NUM, DEN = 4, 85, 100
#: Words of a sketch beyond d + 1, as a share of d + 1.
SLACK = 0.35
#: Bytes of text, and shingles, that go through the array operations at once.
CHUNK = 500_000
#: Shingles and sets of a chunk of candidates that a task compares with another; a larger group is cut into chunks.
CHUNK_SHINGLES, CHUNK_SETS = 1_000_000, 512
#: Sets that a task compares with the smallest one of their word.
STAR = 128
ENTRY = np.dtype([("name", "<u4"), ("times", "<u2")])
TOLD = np.dtype([("name", "<u4"), ("times", "<u4")])


class Bands:
    """Sizes of the bands: band i has the integers from (den/num)^i up to below (den/num)^(i+1)."""

    def __init__(self, largest: int, num: int, den: int) -> None:
        edges = [1]
        power_n, power_d = 1, 1
        while edges[-1] <= 2 * max(1, largest):
            power_n, power_d = power_n * den, power_d * num
            edges.append(-(-power_n // power_d))
        self.edges = np.array(edges)
        top = self.edges[1:] - 1  # the largest size in each band
        self.most = 2 * top * (den - num) // (den + num)  # differences of linked sets
        self.slack = np.ceil(SLACK * (self.most + 1)).astype("i8")
        self.words = self.most + 1 + self.slack

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, sizes, side="right") - 1


class Classes(Block):
    """The different shingle sets of a block, and the rows that have each."""

    def __init__(self, table: pa.Table, size: int) -> None:
        trim()
        texts = table["text"].to_pylist()
        self.ids = table["id"].to_numpy()
        parts = [shingle_sets(texts[p], size) for p in slices([len(x) for x in texts], CHUNK)]
        hashes = [set_hashes(p) for p in parts]
        self.first, self.second = (np.concatenate([np.zeros(0, U), *(h[i] for h in hashes)]) for i in (0, 1))
        self.sizes = np.concatenate([np.zeros(0, "i8"), *(p.sizes for p in parts)])
        order = np.lexsort((self.ids, self.second, self.first))
        new = np.ones(len(order), bool)
        new[1:] = (self.first[order][1:] != self.first[order][:-1]) | (self.second[order][1:] != self.second[order][:-1])
        heads = order[new]  # one row for each class
        heads = np.sort(heads[self.sizes[heads] > 0])
        self.heads = heads
        pick = np.zeros(len(texts), bool)
        pick[heads] = True
        members, done = [np.zeros(0, U)], 0
        while parts:  # each part is let go as it is copied
            p = parts.pop(0)
            n = len(p.sizes)
            members.append(p.members[np.repeat(pick[done : done + n], p.sizes)])
            done += n
        self.sets = Sets(np.concatenate(members), np.concatenate([[0], np.cumsum(self.sizes[heads])]))

    def words(self, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(class, group, name, room) of each word that takes part, a slice of the classes at a time.

        ``group`` tells the two bands of a class apart; ``room`` is how many more words of the group may be left out.
        """
        sizes = self.sets.sizes
        bands = Bands(int(sizes.max(initial=1)), num, den)
        for part in slices(sizes.tolist(), CHUNK):
            for step in (0, 1):
                yield self.words_of(part, bands, step)

    def words_of(self, part: slice, bands: Bands, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``words`` of consecutive classes in their own band (step 0) or the next."""
        sizes = self.sets.sizes[part]
        member = self.sets.members[self.sets.bounds[part.start] : self.sets.bounds[part.stop]]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        band = bands.of(sizes) + step
        k = np.where(bands.most[band] > 0, bands.words[band], 0)  # without differences only equal sets link
        base = np.cumsum(k) - k
        some = k[owner] > 0
        owner, member = owner[some], member[some]
        slot = base[owner] + ((member >> U(20)) % k[owner].astype(U)).astype("i8")
        total = int(k.sum())
        value = np.zeros(total, U)
        np.bitwise_xor.at(value, slot, mix(member ^ (band[owner].astype(U) << U(48))))
        filled = np.bincount(slot, minlength=total)
        cls = np.repeat(np.arange(len(k)), k)
        number = np.arange(total) - base[cls]
        empty = np.bincount(cls, filled == 0, minlength=len(k)).astype("i8")
        slack = np.where(k > 0, bands.slack[band], 0)
        least = np.where(empty <= slack, 1, 0)  # shingles of a word that takes part
        room = np.where(empty <= slack, slack - empty, 0)
        at = np.flatnonzero(filled >= least[cls])
        name = mix(value[at] ^ mix(number[at].astype(U) ^ (band[cls[at]].astype(U) << U(40))))
        return cls[at] + part.start, 2 * (cls[at] + part.start) + step, name, room[cls[at]]


def send_names(table: pa.Table, parts: int, size: int, num: int, den: int) -> pa.Table:
    """Each word of the block once, and how many classes of the block have it."""
    key = np.sort(np.concatenate([np.zeros(0, U), *(short(name, parts) for _, _, name, _ in Classes(table, size).words(num, den))]))
    heads = heads_of(key)
    times = np.minimum(65535, np.diff(np.append(heads, len(key))))
    own = key[heads]
    entry = np.zeros(len(own), ENTRY)
    entry["name"], entry["times"] = own & U(0xFFFFFFFF), times
    bounds = np.searchsorted(own >> U(32), np.arange(parts + 1).astype(U))
    number = table["block"][0].as_py()
    return messages([(p, number, 0, _packed(entry[bounds[p] : bounds[p + 1]])) for p in range(parts) if bounds[p] < bounds[p + 1]])


def _packed(entry: np.ndarray) -> bytes:
    """Names that occur once need no count."""
    once = entry["name"][entry["times"] == 1]
    more = entry[entry["times"] > 1]
    return np.array([len(once)], "<i8").tobytes() + once.tobytes() + more.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    once, more = np.frombuffer(data, "<u4", n, 8), np.frombuffer(data, ENTRY, -1, 8 + 4 * n)
    out = np.zeros(n + len(more), TOLD)
    out["name"][:n], out["times"][:n] = once, 1
    out["name"][n:], out["times"][n:] = more["name"], more["times"]
    return out


def sort_names(table: pa.Table) -> pa.Table:
    """Tell each block which of its words occur more than once, and how often."""
    sorter = table["dest"][0].as_py()
    sent = [(s, _unpacked(d)) for s, d in zip(table["src"].to_pylist(), table["data"].to_pylist(), strict=True)]
    name = np.concatenate([d["name"] for _, d in sent])
    times = np.concatenate([d["times"] for _, d in sent]).astype("i8")
    order = np.argsort(name, kind="stable")
    heads = heads_of(name[order])
    total = np.add.reduceat(times[order], heads)
    known = name[order][heads]
    known, total = known[total > 1], np.minimum(total[total > 1], 2**32 - 1)
    out = []
    for s, d in sent:
        if not len(known):
            break
        at = np.minimum(np.searchsorted(known, d["name"]), len(known) - 1)
        hit = known[at] == d["name"]
        told = np.zeros(int(hit.sum()), TOLD)
        told["name"], told["times"] = d["name"][hit], total[at[hit]]
        if len(told):
            out.append((s, sorter, 0, told.tobytes()))
    return messages(out)


CLASSES = "id long, rid long, n_shingles long, c1 long, c2 long, words array<long>, members binary"


def candidates(docs: pa.Table, told: pa.Table, parts: int, size: int, num: int, den: int) -> pa.Table:
    """A row for each document with its class; the first of a class in the block has its words left in and its set."""
    block = Classes(docs, size)
    words: list[list[int] | None] = [None] * len(block.ids)
    members: list[bytes | None] = [None] * len(block.ids)
    if told.num_rows and len(block.heads):
        all_ = [(np.frombuffer(d, TOLD), s) for s, d in zip(told["src"].to_pylist(), told["data"].to_pylist(), strict=True)]
        known = np.concatenate([d["name"].astype(U) | U(s << 32) for d, s in all_])
        times = np.concatenate([d["times"] for d, _ in all_])
        order = np.argsort(known)
        known, times = known[order], times[order]
        shared = []
        for cls, group, name, room in block.words(num, den):
            key = short(name, parts)
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            hit = np.flatnonzero(known[at] == key)
            shared.append((cls[hit], group[hit], name[hit], room[hit], times[at[hit]].astype("i8"), key[hit]))
        cls, group, name, room, f, key = (np.concatenate(x) for x in zip(*shared, strict=True))
        order = np.lexsort((key, -f, group))
        cls, group, name, room = cls[order], group[order], name[order], room[order]
        heads = heads_of(group)
        rank = np.arange(len(group)) - np.repeat(heads, np.diff(np.append(heads, len(group))))
        left = rank >= room
        cls, name = cls[left], name[left].view("i8")
        order = np.argsort(cls, kind="stable")
        cls, name = cls[order], name[order]
        heads = heads_of(cls)
        for c, a, b in zip(cls[heads].tolist(), heads.tolist(), np.append(heads[1:], len(cls)).tolist(), strict=True):
            words[block.heads[c]] = name[a:b].tolist()
            members[block.heads[c]] = block.sets[c].tobytes()
    return pa.table(
        {
            "id": docs["id"], "rid": docs["rid"], "n_shingles": pa.array(block.sizes, pa.int64()), "c1": pa.array(block.first.view("i8")), "c2": pa.array(block.second.view("i8")),
            "words": pa.array(words, pa.list_(pa.int64())), "members": pa.array(members, pa.binary()),
        }
    )


def links_among(ids: list[int], sets: list[np.ndarray], side: list[int], known: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """Links that join components: of all pairs if all are on one side, else of pairs across the two sides.

    ``known`` tells the components that are known before.
    """
    place = {c: i for i, c in reversed(list(enumerate(known)))}
    root = [place[c] for c in known]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sets, ids, sizes, side_of = [sets[i] for i in order], [ids[i] for i in order], sizes[order], np.array(side)[order]
    back = np.argsort(order)
    root = [int(back[root[i]]) for i in order]
    across = len(set(side)) > 1
    out = []
    reach = np.searchsorted(sizes, sizes * den // num, side="right")  # sets of up to that size can link with a smaller one
    a = 0
    while a < len(sets):
        bits = 1 << max(8, int(4 * sizes[min(int(reach[a]), len(sets)) - 1]).bit_length())
        b = min(len(sets), a + max(1, 4_000_000 // bits))
        b = a + int(np.searchsorted(sizes[a:b], 2 * max(1, sizes[a]), side="right"))  # near sizes share a number of bits
        high = int(reach[b - 1])
        rows = parity_bits(sets[a:b], bits)
        for c in range(a, high, max(1, 4_000_000 // bits)):
            d = min(high, c + max(1, 4_000_000 // bits))
            columns = parity_bits(sets[c:d], bits)
            distance = (bits - rows @ columns.T) / 2
            ok = distance * (den + num) <= (den - num) * (sizes[a:b, None] + sizes[None, c:d]) + 0.5
            ok &= np.arange(c, d)[None, :] > np.arange(a, b)[:, None]
            if across:
                ok &= side_of[a:b, None] != side_of[None, c:d]
            for i, j in zip(*(x.tolist() for x in np.nonzero(ok)), strict=True):
                i, j = a + i, c + j
                ri, rj = find(i), find(j)
                if ri != rj:
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                        root[rj] = ri
                        out.append((ids[i], ids[j]))
        a = b
    return out


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if den * small < num * large:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return den * common >= num * (len(a) + len(b) - common)


def verify_stars(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """(a, b) for each set that links with its hub; rows are (hub, salt, kind, cls, members), the hub's own (kind 0) first."""
    trim()
    key = middle = None
    for batch in batches:
        out = []
        for hub, salt, kind, cls, members in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
            own = np.frombuffer(members, "<u8")
            if kind == 0:
                key, middle = (hub, salt), own
            elif (hub, salt) == key and similar(middle, own, num, den):
                out.append((hub, cls))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])


def verify_chunks(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Candidates (group, i, j, cls, component, side, members) arrive sorted by group; one is compared when the next begins."""

    def compared(rows) -> pa.RecordBatch:
        cls, component, side, members = zip(*rows, strict=True)
        pairs = links_among(list(cls), [np.frombuffer(m, "<u8") for m in members], list(side), list(component), num, den)
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    key, rows = None, []
    for batch in batches:
        for group, i, j, *row in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
            if (group, i, j) != key:
                if len(rows) > 1:
                    yield compared(rows)
                key, rows = (group, i, j), []
            rows.append(row)
    if len(rows) > 1:
        yield compared(rows)


def star_links(active: DataFrame, met: DataFrame, hubs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links between classes and the smallest class of one of their words; a hub's set goes to as many tasks as its star needs."""
    near = keep(join_counted(met, hubs, ["word"]).where(F.col("cls") != F.col("hub")).select("cls", "hub").distinct())
    stars = keep(near.groupBy("hub").agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / STAR).cast("int")))
    salt = F.pmod(F.xxhash64("cls"), F.col("salts")).cast("int")
    points = join_counted(near, stars, ["hub"]).select("cls", "hub", salt.alias("salt")).join(active.select("cls", "members"), "cls").select("hub", "salt", F.lit(1).alias("kind"), "cls", "members")
    middles = active.select(F.col("cls").alias("hub"), "members").join(stars, "hub").select(
        "hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("hub").alias("cls"), "members"
    )
    met_there = points.unionByName(middles).repartition(n, "hub", "salt").sortWithinPartitions("hub", "salt", "kind")
    return met_there.mapInArrow(lambda b: verify_stars(b, num, den), "a long, b long")


def rest_links(active: DataFrame, met: DataFrame, hubs: DataFrame, known: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links between classes that share a word of three or more classes and are in different known components.

    Known components that such words connect are compared together, so a class is sent once, however many words it has.
    """
    members = join_counted(met, hubs.where("n > 2"), ["word"]).select("word", "cls").join(known, F.col("cls") == F.col("node"), "left")
    members = keep(members.select("word", "cls", F.coalesce("component", "cls").alias("component")))
    open_ = keep(members.groupBy("word").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high"))
    left = keep(join_counted(members, open_, ["word"]).select("cls", "component", "low").distinct())
    groups = connected_components(left.select(F.col("component").alias("a"), F.col("low").alias("b")))
    rows = left.select("cls", "component").distinct().join(groups.select(F.col("node").alias("component"), F.col("component").alias("group")), "component")
    rows = keep(rows.join(active.select("cls", "n_shingles"), "cls"))
    chunks = F.greatest(F.ceil(F.sum("n_shingles") / CHUNK_SHINGLES), F.ceil(F.count("*") / CHUNK_SETS)).cast("int")
    sizes = keep(rows.groupBy("group").agg(chunks.alias("chunks"), F.count("*").alias("n")))
    own, other = F.col("own"), F.col("other")
    placed = (
        join_counted(rows.drop("n_shingles"), sizes, ["group"])
        .join(active.select("cls", "members"), "cls")
        .withColumn("own", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(
            "group", F.least(own, other).alias("i"), F.greatest(own, other).alias("j"), "cls", "component",
            F.when(own == other, 0).when(own < other, 1).otherwise(2).alias("side"), "members",
        )
    )
    keys = ["group", "i", "j"]
    return placed.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(lambda b: verify_chunks(b, num, den), "a long, b long")


def link_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, num: int = NUM, den: int = DEN, blocks: int | None = None
) -> DataFrame:
    """(id, rid, n_shingles, group, component) for each row: the size of its set, its group, and the group's smallest id.

    Shingles are distinct runs of ``size`` words (other than ASCII white space, A-Z in lower case); a text of fewer words
    is one shingle.  Groups are what links reach; ``rid`` is a hash of id and text.  Texts without words have no shingles
    and link with nothing, not even with each other: no group, and their own id.  A null id is given as LAST_ID, after
    all others.  Rows that share an id are compared like any two rows.  Empty table: empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    blocks, n = layout(docs, text_col, blocks)
    texts = into_blocks(docs, id_col, text_col, blocks).select("block", "id", F.xxhash64("id", F.col("text").cast("string")).alias("rid"), "text")
    names = texts.groupBy("block").applyInArrow(lambda t: send_names(t, n, size, num, den), MESSAGE)
    told = names.groupBy("dest").applyInArrow(sort_names, MESSAGE)
    rows = keep(texts.groupBy("block").cogroup(told.groupBy("dest")).applyInArrow(lambda t, m: candidates(t, m, n, size, num, den), CLASSES))

    # a class is a node of the graph by the first hash of its set
    active = keep(rows.where(F.col("members").isNotNull()).dropDuplicates(["c1", "c2"]).select(F.col("c1").alias("cls"), "n_shingles", "words", "members"))
    met = active.select("cls", F.explode("words").alias("word"))  # read again from the written table each time
    hubs = keep(met.groupBy("word").agg(F.min("cls").alias("hub"), F.count("*").alias("n")).where("n > 1"))
    first = keep(star_links(active, met, hubs, n, num, den))
    links = first.unionByName(rest_links(active, met, hubs, connected_components(first), n, num, den))
    linked = connected_components(links)
    sized = rows.where("n_shingles > 0").groupBy("c1").agg(F.min("id").alias("id"))
    grouped = keep(sized.join(linked, F.col("c1") == F.col("node"), "left").select("c1", "id", F.coalesce("component", "c1").alias("group")))
    smallest = grouped.groupBy("group").agg(F.min("id").alias("component"))
    found = rows.select("id", "rid", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("c1")).alias("c1"))
    named = grouped.select("c1", "group").join(smallest, "group")
    return found.join(named, "c1", "left").select("id", "rid", "n_shingles", "group", F.coalesce("component", "id").alias("component"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """One row of each group, with the same columns: the one with the smallest id.

    Of rows that share the smallest id, the one with the smallest hash of its text stays.  Rows without words are in no
    group and all stay.  Rows without an id come last, but are rows of their own.
    """
    found = link_documents(docs, id_col, text_col, **rules)
    stays = found.where(F.col("group").isNotNull() & (F.col("id") == F.col("component"))).groupBy("group", "id").agg(F.min("rid").alias("rid"))
    packed = pack(docs, id_col, text_col).withColumn("rid", F.xxhash64("id", "text"))
    wordless = F.btrim("text", F.lit(BLANKS)) == ""
    chosen = packed.where(~wordless).join(stays.select("id", "rid"), ["id", "rid"], "left_semi").dropDuplicates(["id", "rid"])
    return chosen.select("row").unionByName(packed.where(wordless).select("row")).select(*[field("row", c).alias(c) for c in docs.columns])
