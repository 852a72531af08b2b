"""Spelling variants: words one edit apart, found by merging the light subtrees of a trie with one character in error."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, partitions, small, texts

#: Runs of these are words; the text's A-Z are lower case by then.
LETTERS = "[a-zÀ-ÿ]+"
#: Words and code points that a block of the sorted words holds at most (one word at least).
BLOCK_WORDS, BLOCK_POINTS = 20_000, 2_000_000
#: Words that a task counts before it passes them on.
HELD = 200_000


def count_words(docs: DataFrame, shortest: int = 7, least: int = 2, damage: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: maximal runs of letters of the whole texts (null: none) with only A-Z lower-cased, that have ``shortest``
    code points and occur ``least`` times. ``damage``: where it divides the crc32 of ``<id>:<run>`` (null id: empty), the
    run first loses the code point at that crc32 modulo its length. Counts are summed in tasks before they are shuffled."""

    def run(batches):
        import pyarrow as pa

        letters = re.compile(LETTERS)
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for b in small(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), texts(b)):
                before = f"{'' if doc_id is None else doc_id}:"
                for word, n in Counter(letters.findall(text.lower().decode())).items():  # bytes.lower() knows A-Z only
                    if len(word) < shortest:
                        continue
                    if damage:
                        h = zlib.crc32((before + word).encode())
                        if h % damage == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < shortest:
                                continue
                    held[word] += n
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        yield out()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def common_prefix(a: str, b: str) -> int:
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    low, high = 0, most  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def prefix_digests(word: str) -> list[bytes]:
    """128 bits for each prefix, the empty and the whole one too: they name the trie's nodes."""
    import xxhash

    h, out = xxhash.xxh3_128(), []
    out.append(h.digest())
    for c in word:
        h.update(c.encode())
        out.append(h.digest())
    return out


def branching_nodes(words: list[str]):
    """``depth, low, high, starts`` of each node of the trie of sorted distinct ``words`` where words part: the words
    ``low:high`` share ``depth`` code points, and each of ``starts`` begins a child (the first may be a word that ends)."""
    stack: list[list] = []
    for i in range(1, len(words) + 1):
        shared = common_prefix(words[i - 1], words[i]) if i < len(words) else -1
        low = i - 1
        while stack and stack[-1][0] > shared:
            depth, low, starts = stack.pop()
            yield depth, low, i, starts
        if shared >= 0:
            if stack and stack[-1][0] == shared:
                stack[-1][2].append(i)
            else:
                stack.append([shared, low, [low, i]])


def errata(word: str, depth: int, heavy: str | None, shortest: int):
    """What a word on a light edge of the node ``word[:depth]`` turns into by one error at the node: its next code point
    skipped (unless the one after it is the same: then the words part further down), replaced by the heavy child's, or
    preceded by that. A word that ends at the node gets the heavy child's. Only these meet the words of the heavy
    subtree, which are never merged into anything."""
    p, c, r = word[:depth], word[depth : depth + 1], word[depth + 1 :]
    out = []
    if c and r[:1] != c:
        out.append(p + r)
    if heavy:
        out.append(p + heavy + c + r)
        if c:
            out.append(p + heavy + r)
    return [x for x in out if len(x) >= shortest]


def _blocks(words: DataFrame) -> DataFrame:
    """``block, words, counts``: runs of all words in order."""

    def run(batches):
        import pyarrow as pa

        part, at, words, counts, points = TaskContext.get().partitionId(), 0, [], [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + at], pa.int64()), pa.array([words], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64()))], ["block", "words", "counts"])

        for b in batches:
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if words and (len(words) >= BLOCK_WORDS or points + len(w) > BLOCK_POINTS):
                    yield out()
                    at, words, counts, points = at + 1, [], [], 0
                words.append(w)
                counts.append(n)
                points += len(w)
        if words:
            yield out()

    ranged = words.repartitionByRange(partitions(words.sparkSession), "word").sortWithinPartitions("word")
    return ranged.mapInArrow(run, "block long, words array<string>, counts array<long>")


def _edge_paths(words: list[str]) -> list[tuple[int, int, int, bytes]]:
    """``depth, low, high, digest`` of the nodes of a block that other blocks may share: the prefixes of its first and its
    last word, each once, and which of the block's words are below."""
    first, last = words[0], words[-1]
    out, n = [], len(words)
    both = common_prefix(first, last)
    high = n
    for depth, name in enumerate(prefix_digests(first)):
        while high > 1 and (len(words[high - 1]) < depth or words[high - 1][:depth] != first[:depth]):
            high -= 1
        out.append((depth, 0, high, name))
    low = 0
    for depth, name in enumerate(prefix_digests(last)):
        if depth > both:
            while low < n - 1 and words[low][:depth] != last[:depth]:
                low += 1
            out.append((depth, low, n, name))
    return out


def _children(words: list[str], depth: int, low: int, high: int):
    """``child, number`` of the node that the words ``low:high`` share."""
    at = low
    while at < high:
        c, end = words[at][depth : depth + 1], at + 1
        while end < high and words[end][depth : depth + 1] == c:
            end += 1
        yield c, end - at
        at = end


def _open_nodes(blocks: DataFrame) -> DataFrame:
    """``block, node, heavy, lights`` for the nodes on the edges of blocks where words part: the child with most words of all
    blocks (of equals the smaller code point) and the number of other children."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for block, words in zip(b.column(0).to_pylist(), (x.as_py() for x in b.column(1))):
                rows = [(block, name, c, n) for depth, low, high, name in _edge_paths(words) for c, n in _children(words, depth, low, high)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.string(), pa.int64()))], ["block", "node", "child", "n"])

    paths = materialise(blocks.select("block", "words").mapInArrow(run, "block long, node binary, child string, n long"), "paths")
    child = paths.groupBy("node", "child").agg(F.sum("n").alias("n"))
    most = F.min(F.when(F.col("child") != "", F.struct((-F.col("n")).alias("n"), "child")))
    node = child.groupBy("node").agg(F.count("*").alias("ways"), most.alias("most"), F.count_if(F.col("child") != "").alias("children")).where("ways > 1")
    node = node.select("node", F.col("most.child").alias("heavy"), (F.col("children") - 1).alias("lights"))
    return paths.select("block", "node").distinct().join(node, "node")


def _merge(blocks: DataFrame, shortest: int) -> DataFrame:
    """``kind, key, word, n, near``. Below a node inside a block all is found there: kind ``n``, a word with its number of near
    ones and the one with most occurrences. Words on light edges of nodes that blocks share: kind ``a``, what an error at
    the node turns them into; kind ``s``, their place in the merged subtrees of the node's light children."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("kind", pa.string()), ("key", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("near", pa.int64())])

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

        for b in batches:
            for i in range(b.num_rows):
                words, counts = b.column(1)[i].as_py(), b.column(2)[i].as_py()
                shared = {x["node"]: (x["heavy"], x["lights"]) for x in b.column(3)[i].as_py() or ()}
                rows = []
                for depth, low, high, name in _edge_paths(words):
                    heavy, lights = shared.get(name, (None, -1))
                    if lights < 0:
                        continue
                    for w, n in zip(words[low:high], counts[low:high]):
                        if w[depth : depth + 1] == heavy:
                            continue
                        rows += [("a", x, w, n, 0) for x in errata(w, depth, heavy, shortest)]
                        if lights > 1 and len(w) > depth:
                            rows.append(("s", f"{w[:depth]}\0{w[depth + 1 :]}", w, n, 0))
                    if len(rows) > 20_000:
                        yield out(rows)
                        rows = []
                place, near, best = {w: j for j, w in enumerate(words)}, [0] * len(words), [None] * len(words)

                def met(j, k):
                    for x, y in ((j, k), (k, j)):
                        near[x] += 1
                        said = (-counts[y], words[y])
                        if best[x] is None or said < best[x]:
                            best[x] = said

                for depth, low, high, starts in branching_nodes(words):
                    if low == 0 or high == len(words):
                        continue  # on an edge: above
                    ends = [*starts[1:], high]
                    ranges = [(words[s][depth : depth + 1], s, e) for s, e in zip(starts, ends)]
                    heavy = min(((s - e, c) for c, s, e in ranges if c), default=(0, None))[1]
                    merged = defaultdict(list)
                    for c, s, e in ranges:
                        if c == heavy:
                            continue
                        for j in range(s, e):
                            for x in errata(words[j], depth, heavy, shortest):
                                if x in place:
                                    met(j, place[x])
                            if c and len(ranges) > 2:
                                merged[words[j][depth + 1 :]].append(j)
                    for same in merged.values():
                        for k, j in enumerate(same):  # as many as there are letters at most
                            for other in same[:k]:
                                met(j, other)
                rows += [("n", best[j][1], words[j], -best[j][0], near[j]) for j in range(len(words)) if near[j]]
                if rows:
                    yield out(rows)

    return blocks.mapInArrow(run, "kind string, key string, word string, n long, near long")


def spelling_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of ``words(word, n)`` (distinct, not null).

    Two words are near if one code point inserted, deleted or replaced makes one of the other. ``form`` is the near word
    with most occurrences (ties: the smallest), if it has ``ratio`` times the word's at least, else null; ``root`` is where
    forms lead in the end, the word itself if it has none.

    The trie of all words is cut by heavy paths. Two near words part at one node, and at most one of them goes on in the
    node's heavy child; so each word on a light edge, of which its path has log2(words) at most, is merged into the heavy
    subtree with its code point skipped, replaced or preceded, and with the other light ones under the code point
    skipped. Terminals that coincide are near, each pair once. The trie is dealt out as sorted blocks of words; nodes
    within a block are merged in its task, for the others the errata are joined with all words. Counts of children are
    summed over blocks, so that every block takes the same child for the heavy one. No group is larger than the alphabet,
    and no pair of a hot word's many variants meets another.

    No words: no rows. Words of any length: a node's name has 16 bytes, blocks are cut by code points too."""
    spark = words.sparkSession
    words = materialise(words.select("word", F.col("n").cast("long").alias("n")), "words")
    blocks = materialise(_blocks(words), "blocks")
    shortest = words.agg(F.min(F.char_length("word"))).first()[0] or 0
    known = _open_nodes(blocks).groupBy("block").agg(F.collect_list(F.struct("node", "heavy", "lights")).alias("shared"))
    with_shared = blocks.join(known, "block", "left").select("block", "words", "counts", "shared")
    found = materialise(_merge(with_shared.repartition(partitions(spark), "block"), shortest), "errata")

    asked = found.where("kind = 'a'").join(words.select(F.col("word").alias("key"), F.col("n").alias("key_n")), "key")
    way = F.array(F.struct("word", F.col("key_n").alias("n"), F.col("key").alias("form")), F.struct(F.col("key").alias("word"), "n", F.col("word").alias("form")))
    hits = asked.select(F.explode(way).alias("x")).select("x.word", F.lit(1).cast("long").alias("near"), "x.n", "x.form")
    group = found.where("kind = 's'").groupBy("key").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))).alias("same")).where(F.size("same") > 1)
    one = group.select(F.explode("same").alias("x"), F.get("same", F.lit(0)).alias("a"), F.get("same", F.lit(1)).alias("b"), (F.size("same") - 1).cast("long").alias("near"))
    other = F.when(F.col("x.word") == F.col("a.word"), F.col("b")).otherwise(F.col("a"))
    siblings = one.select(F.col("x.word").alias("word"), "near", (-other["n"]).alias("n"), other["word"].alias("form"))
    inside = found.where("kind = 'n'").select("word", "near", "n", F.col("key").alias("form"))
    per = inside.unionByName(hits).unionByName(siblings).groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), "form")).alias("best"))

    out = words.join(per, "word", "left")
    good = -F.col("best.n") >= ratio * F.col("n")
    out = materialise(
        out.select("word", F.when(good, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, -F.col("best.n")).alias("form_n")), "forms"
    )
    discard(found, blocks)
    lead = materialise(out.where("form is not null").select("word", F.col("form").alias("root")), "roots", True)
    while True:  # each round doubles how far a word has been followed; n grows tenfold at each step, so a few do
        on = lead.join(lead.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        new = materialise(on.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots", True)
        discard(lead)
        lead = new
        if new.where("moved").isEmpty():
            break
    return out.join(lead.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
