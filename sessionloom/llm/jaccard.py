"""Near-duplicate join of documents by Jaccard similarity of word n-grams, with MinHash bands and exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import mix, ngrams, same_spans, span_hashes, stash, steps, text_or_empty, tidy, Words, words

NGRAM = 5
THRESHOLD = 0.8
#: Share of pairs at the threshold that at least one band must catch.
RECALL = 0.9999
#: Similarity of unrelated texts that share stock phrases: what the choice of bands reckons as false candidates.
BACKGROUND = 0.3
#: Members of a bucket that are verified against each other at once, and bytes of their words; a larger bucket is cut into blocks.
BLOCK_MEMBERS = 256
BLOCK_BYTES = 24 << 20
#: Bytes of text of a step, small enough for its hashes to stay in a core's cache.
HASH_STEP = 1 << 19
#: Numbers that a dense block of the incidence matrix may have.
DENSE = 4 << 20


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, background: float = BACKGROUND) -> tuple[int, int]:
    """Bands and rows: of those that reach the recall at the threshold, the cheapest in hashes and in false candidates (each as dear as 300 hashes)."""
    best = None
    for rows in range(1, 13):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))) if threshold < 1 else 1
        cost = bands * rows + 300 * bands * background**rows
        if best is None or cost < best[0]:
            best = cost, bands, rows
    return best[1:]


def grams_of(found: Words, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text, the first word and the last word of every word n-gram. A text of fewer words, but not none, has one gram of all of them."""
    of, count = found.of(), np.diff(found.first)
    first = np.flatnonzero(of[: max(0, len(of) - n + 1)] == of[n - 1 :])
    text, last = of[first], first + n - 1
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        text, first, last = np.concatenate([text, short]), np.concatenate([first, found.first[short]]), np.concatenate([last, found.first[short + 1] - 1])
    return text, first, last


def gram_hashes(hashed: np.ndarray, first: np.ndarray, last: np.ndarray, n: int = NGRAM) -> np.ndarray:
    """64-bit hashes of the grams, from their words' hashes."""
    out = np.zeros(len(first), np.uint64)
    whole = last - first == n - 1
    out[whole] = ngrams(hashed, n)[first[whole]]
    for k in np.flatnonzero(~whole).tolist():
        out[k] = ngrams(hashed[first[k] : last[k] + 1], int(last[k] - first[k] + 1))[0]
    return out


def gram_sets(data: np.ndarray, offsets: np.ndarray, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
    """Hashes of the distinct word n-grams of each text, ascending, one text after the other; second hashes of them by another function; the texts' offsets; and the words."""
    found = words(data, offsets)
    text, first, last = grams_of(found, n)
    gram = gram_hashes(found.hash, first, last, n)
    order = np.lexsort((gram, text))
    text, gram = text[order], gram[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])
    order = order[new]
    low = gram_hashes(span_hashes(found.folded, found.start, found.end, 1), first[order], last[order], n)
    return gram[new], low, np.searchsorted(text[new], np.arange(len(offsets))), found


def band_keys(grams: np.ndarray, ends: np.ndarray, bands: int, rows: int, seed: int = 5) -> np.ndarray:
    """For each non-empty set one 64-bit key per band of MinHashes."""
    random = np.random.default_rng(seed)
    flip = random.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    times = random.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    starts = ends[:-1][np.diff(ends) > 0]
    keys = np.zeros((len(starts), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(starts), b, np.uint64)
        for r in range(b * rows, (b + 1) * rows):
            key = key * np.uint64(0xD6E8FEB86659FD93) + mix(np.minimum.reduceat((grams ^ flip[r]) * times[r], starts))
        keys[:, b] = mix(key)
    return keys


SIGNATURES = "doc_id long, text_key long, node long, node_low long, bytes long, bands array<bigint>"


def _digests(grams: np.ndarray, low: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Two independent 64-bit digests of each non-empty set of grams."""
    starts = ends[:-1][np.diff(ends) > 0]
    if not len(starts):
        return [np.zeros(0, np.int64)] * 2
    return [mix(np.add.reduceat(mix(x ^ np.uint64(salt)), starts)).view(np.int64) for x, salt in ((grams, 0x51ED270B9F3A7C15), (low, 0xA0761D6478BD642F))]


def signatures(documents: DataFrame, text: str, doc_id: str, n: int, bands: int, rows: int) -> DataFrame:
    """Per document: a 128-bit digest of its n-gram set (node, node_low), the bytes of its words, and its band keys; null for a text without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows_, data, offsets in steps(batch, "t", HASH_STEP):
                grams, low, ends, found = gram_sets(data, offsets, n)
                some = np.diff(ends) > 0
                keys = band_keys(grams, ends, bands, rows) if some.any() else np.zeros((0, bands), np.uint64)
                full = [np.zeros(len(some), np.int64) for _ in range(2)]
                for whole, part in zip(full, _digests(grams, low, ends)):
                    whole[some] = part
                size = np.add.reduceat(np.append(found.end - found.start + 1, 0), found.first[:-1]) * some if len(some) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some)]) * bands, pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([rows_.column("doc_id"), rows_.column("text_key"), *(pa.array(x, mask=~some) for x in full), pa.array(size.astype(np.int64)), lists], names=names)

    names = [c.split()[0] for c in SIGNATURES.split(", ")]
    return _keyed(documents, text, doc_id).mapInArrow(tidy(sign), SIGNATURES)


def _keyed(documents: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, text and a hash of the text: what tells rows apart."""
    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("t")).select("doc_id", F.xxhash64("t").alias("text_key"), "t")


def exact_grams(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The text and a number of each distinct gram of some folded texts (words with single spaces between): equal numbers for equal grams only, since where hashes agree the bytes are compared."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = words(data, offsets)
    text, first, last = grams_of(found, n)
    start, end = found.start[first], found.end[last]
    _, example, number = np.unique(gram_hashes(found.hash, first, last, n), return_index=True, return_inverse=True)
    like = example[number]
    others: dict[bytes, int] = {}
    for k in np.flatnonzero(~same_spans(found.folded, start, end, found.folded, start[like], end[like])).tolist():
        number[k] = others.setdefault(found.folded[start[k] : end[k]].tobytes(), len(example) + len(others))
    both = np.unique(text.astype(np.int64) << 40 | number)
    return both >> 40, both & ((1 << 40) - 1)


def shared_counts(owner: np.ndarray, gram: np.ndarray, m: int) -> np.ndarray:
    """How many grams all pairs of m sets share; of each gram in a set there is one row (owner, gram)."""
    counts = np.zeros((m, m))
    size = np.bincount(owner, minlength=m)
    order = np.argsort(gram, kind="stable")
    owner, column = owner[order], np.unique(gram[order], return_inverse=True)[1]
    often = np.bincount(column)[column] > 1 if len(column) else np.zeros(0, bool)
    owner, column = owner[often], np.unique(column[often], return_inverse=True)[1]
    width = max(64, DENSE // m)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(column, column[at] + width))
        block = np.zeros((m, int(column[end - 1] - column[at]) + 1), np.float32)
        block[owner[at:end], column[at:end] - column[at]] = 1
        counts += block @ block.T
        at = end
    counts[np.arange(m), np.arange(m)] = size
    return counts


def _verify(members: list[tuple], band: int, across: bool, threshold: float, n: int) -> list[tuple[int, ...]]:
    """Of a block's members (node, node_low, copies, left side, keys, folded text): each linked node with the copies its links stand for and the least node it is connected with here. A pair counts in the first band that it shares, so in one block only."""
    m = len(members)
    shared = shared_counts(*exact_grams([x[5] for x in members], n), m)
    size = shared.diagonal()
    near = shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-9
    side = np.array([x[3] for x in members])
    near &= (side[:, None] & ~side[None, :]) if across else np.triu(np.ones(near.shape, bool), 1)
    a, b = np.nonzero(near)
    keys = np.array([x[4] for x in members])
    if band and len(a):
        fresh = ~(keys[a, :band] == keys[b, :band]).any(1)
        a, b = a[fresh], b[fresh]
    if not len(a):
        return []
    copies = np.array([x[2] for x in members], np.int64)
    links = np.zeros(m, np.int64)
    np.add.at(links, a, copies[b])
    np.add.at(links, b, copies[a])
    ordered = sorted(range(m), key=lambda k: members[k][:2])
    root = np.empty(m, np.int64)
    root[ordered] = np.arange(m)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        if (root == before).all():
            break
    return [(*members[k][:2], int(links[k]), *members[ordered[root[k]]][:2]) for k in np.flatnonzero(links).tolist()]


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b): the least node connected with it. Large and small stars in turn, each two aggregations and joins, each round written; nothing is gathered per node."""
    edges = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b"))).where("a <> b")
        edges = stash(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now


def _number(high: str, low: str):
    """A node's digest as one number of up to 120 bits."""
    return F.expr(f"cast({high} & {(1 << 56) - 1} AS decimal(20,0)) * cast('{1 << 64}' AS decimal(20,0)) + cast({low} AS decimal(20,0)) + cast('{1 << 63}' AS decimal(20,0))").cast("decimal(38,0)")


def _classes(documents: DataFrame, text: str, doc_id: str, n: int, threshold: float, recall: float) -> DataFrame:
    """``jaccard_classes`` with text_key and root, a number of the class (null for a wordless text)."""
    bands, rows = choose_bands(threshold, recall)
    node = ["node", "node_low"]
    signed = stash(signatures(documents, text, doc_id, n, bands, rows))
    nodes = (
        signed.where("node IS NOT NULL")
        .groupBy(*node)
        .agg(F.min("doc_id").alias("copy_of"), F.min(F.struct("doc_id", "text_key")).alias("at"), F.count("*").alias("copies"), F.first("bytes").alias("bytes"), F.first("bands").alias("bands"))
    )
    keyed = nodes.select(*node, "bytes", F.posexplode("bands").alias("band", "key"))
    buckets = (
        keyed.groupBy("band", "key")
        .agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64(*node)).alias("x"), F.sum(F.xxhash64(*node, F.lit(1)) % (1 << 40)).alias("s"), F.sum("bytes").alias("bytes"))
        .where("members > 1")
        .groupBy("members", "x", "s")
        .agg(F.min(F.struct("band", "key", "bytes")).alias("b"))
        .select("b.band", "b.key", F.greatest(F.ceil(F.col("members") / BLOCK_MEMBERS), F.ceil(F.col("b.bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    )
    where = keyed.join(buckets, ["band", "key"]).groupBy(*node).agg(F.collect_list(F.struct("band", "key", "blocks")).alias("buckets"))
    wanted = nodes.join(where, node).select(F.col("at.doc_id").alias("at_doc"), F.col("at.text_key").alias("at_key"), *node, "copies", "bands", "buckets")
    texts = _keyed(documents, text, doc_id)

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows_, data, offsets in steps(batch, "t", HASH_STEP):
                grams, low, ends, found = gram_sets(data, offsets, n)
                some = np.flatnonzero(np.diff(ends) > 0)
                own = dict(zip(some.tolist(), zip(*(d.tolist() for d in _digests(grams, low, ends)))))
                out: list[tuple] = []
                held, sent = 0, None
                for k, (high_, low_, copies, keys, places) in enumerate(zip(*(rows_.column(c).to_pylist() for c in (*node, "copies", "bands", "buckets")))):
                    # other texts under the same key, and repeated rows, which are neighbours, stay
                    if own.get(k) != (high_, low_) or sent == (high_, low_):
                        continue
                    sent = high_, low_
                    a, b = found.first[k], found.first[k + 1]
                    raw, signs = b" ".join([found.folded[x:y].tobytes() for x, y in zip(found.start[a:b].tolist(), found.end[a:b].tolist())]), np.array(keys, np.int64).tobytes()
                    for bucket in places:
                        mine = high_ % bucket["blocks"]
                        for other in range(bucket["blocks"]):
                            out.append((bucket["band"], bucket["key"], min(mine, other), max(mine, other), high_, low_, copies, mine <= other, signs, raw))
                            held += len(raw) + 200
                            if held > 8 << 20:
                                yield _rows(out, SHIPPED_ARROW)
                                out, held = [], 0
                yield _rows(out, SHIPPED_ARROW)

    shipped = wanted.join(texts, F.col("at_doc").eqNullSafe(F.col("doc_id")) & (F.col("at_key") == F.col("text_key"))).select(*node, "copies", "bands", "buckets", "t").mapInArrow(tidy(ship), SHIPPED)
    place = ["band", "key", "low", "high"]
    dealt = shipped.repartition(*place).sortWithinPartitions(*place)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, out = None, {}, []
        for batch in batches:
            for *at, high_, low_, copies, left, signs, raw in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
                if at != now:
                    if len(members) > 1:
                        out += _verify(list(members.values()), now[0], now[2] != now[3], threshold, n)
                    now, members = at, {}
                members[high_, low_] = (high_, low_, copies, left, np.frombuffer(signs, np.int64), raw)
            yield _rows(out, LINKS_ARROW)
            out = []
        if len(members) > 1:
            yield _rows(_verify(list(members.values()), now[0], now[2] != now[3], threshold, n), LINKS_ARROW)

    links = stash(dealt.mapInArrow(tidy(verify), LINKS))
    roots = connected(links.select(_number("node", "node_low").alias("a"), _number("root", "root_low").alias("b")))
    summed = links.groupBy(*node).agg(F.sum("links").alias("links"))
    known = nodes.select(*node, "copy_of", "copies", _number(*node).alias("number")).join(summed, node, "left").join(roots.withColumnRenamed("node", "number"), "number", "left").withColumn("root", F.coalesce("root", "number"))
    least = known.groupBy("root").agg(F.min("copy_of").alias("class_id"))
    known = known.join(least, "root").select(*node, "copy_of", "class_id", "root", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return signed.select("doc_id", "text_key", *node).join(known, node, "left").select(
        "doc_id", "text_key", "root", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_of", "doc_id").alias("copy_of"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def jaccard_classes(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Documents with their near-duplicate class and number of links.

    Words are runs of 0-9, a-z (A-Z lower-cased) and non-ASCII characters. Two documents are linked if the Jaccard
    similarity of their word n-gram sets is at least ``threshold``; classes are what links connect. Documents with equal sets, by two independent
    64-bit digests, are one node, so copies never multiply. Nodes meet in a bucket per band key; buckets with the same members are
    handled once; texts travel to the remaining buckets with two members or more, and every pair is verified there on the full sets of n-grams, in the
    first band it shares: equal n-grams are those whose bytes are equal. Buckets of over BLOCK_MEMBERS nodes or BLOCK_BYTES are cut into blocks and
    verified block by block in as many tasks. A block returns, for each node, its number of links and one edge to the least node it is connected with: no pairs.

    Returns doc_id, class_id (least doc_id of the class), copy_of (least doc_id with the same n-gram set), n_links
    (documents linked with this one, copies included). Null and wordless texts are classes of their own without links. Rows that
    repeat a doc_id count as documents, each with its own text's result. A row without a doc_id is linked as others are; class_id and copy_of are null only
    where no row of the class, or of the copies, has one. Other columns are ignored. An empty table gives no rows.
    """
    return _classes(documents, text, doc_id, n, threshold, recall).drop("text_key", "root")


def first_of_each_class(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of ``documents`` less near duplicates: of each class of ``jaccard_classes`` the row with the least doc_id stays (rows without one come last; of one doc_id the text with the least hash).

    What goes goes by doc_id and text together, so another text under the same doc_id stays. Null and wordless texts stay. Rows that agree in doc_id and text are one
    document told several times, of which one stays. All columns are kept.
    """
    names = documents.columns
    plain = [f"c{k}" for k in range(len(names))]
    text, doc_id = plain[names.index(text)], plain[names.index(doc_id)]
    rows = documents.toDF(*plain)
    classes = _classes(rows, text, doc_id, n, threshold, recall)
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    placed = classes.where("root IS NOT NULL").select("root", "doc_id", "text_key", rank.alias("rank"))
    heads = placed.groupBy("root").agg(F.min("rank").alias("head")).select(F.col("head.doc_id").alias("head_doc"), F.col("head.text_key").alias("head_key"))
    # by the row and not by the class, of which one may hold a third of all
    gone = placed.join(heads, F.col("doc_id").eqNullSafe(F.col("head_doc")) & (F.col("text_key") == F.col("head_key")), "left_anti").select(F.col("doc_id").alias("gone_doc"), F.col("text_key").alias("gone_key")).distinct()
    key = F.xxhash64(text_or_empty(text))
    left = rows.join(gone, F.col(doc_id).cast("long").eqNullSafe(F.col("gone_doc")) & (key == F.col("gone_key")), "left_anti")
    if not classes.groupBy("doc_id", "text_key").count().where("count > 1").isEmpty():
        # a null text is not an empty one
        left = left.withColumns({"own_key": key, "own_null": F.col(text).isNull()}).dropDuplicates([doc_id, "own_key", "own_null"]).drop("own_key", "own_null")
    return left.toDF(*names)


SHIPPED = "band int, key long, low int, high int, node long, node_low long, copies long, left boolean, signs binary, words binary"
SHIPPED_ARROW = pa.schema([("band", pa.int32()), ("key", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("node", pa.int64()), ("node_low", pa.int64()), ("copies", pa.int64()), ("left", pa.bool_()), ("signs", pa.binary()), ("words", pa.binary())])
LINKS = "node long, node_low long, links long, root long, root_low long"
LINKS_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in LINKS.split(", ")])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)
