"""Near-duplicate components by exact Jaccard similarity of word shingles, with a token-group matrix.

1. Equal sets become one. Sets that agree in a band of least hashes are drawn to two pivots, the pairs are verified,
   and what hangs together becomes a cluster; a cluster is cut into groups of about GROUP sets. Sets that hang with none
   are grouped by the least pivot that they were drawn to, so that texts just below the threshold share unions too.
2. The matrix says which groups hold a token. Only tokens that can decide are in it: in one order of all tokens,
   frequent ones last, two sets of the wanted similarity share one of their first fifth.
3. A set is held against groups of other clusters that share so many such tokens as its bound asks for, and fit in size.
   Of what two sets have in common, all but the last four fifths of one of them is among these tokens. The size of its
   overlap with a group's union bounds the overlap with every member; only groups that qualify are opened. Against its
   own group of sets without links, it is the overlap with the tokens that two members have.
4. The links found by 1 and 3 connect all that the links of all pairs connect: pairs inside a cluster are connected
   already, and every other pair of the wanted similarity is opened by 3.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmine.functions.bits import bit_field
from postmine.llm.links import components
from postmine.llm.rows import in_slices, map_batches, partitions, settle

WORDS = 5
#: Similarity of at least 4 / 5.
PART, WHOLE = 4, 5
GROUP = 64
#: About so many sets meet a group's members in one go.
ASKING = 1024
#: A worker holds the words of so many texts, or the tokens of so many pairs of sets, at a time.
TEXTS_AT_ONCE, PAIRS_AT_ONCE = 2500, 256
BANDS, BAND_ROWS = 8, 4
#: A set is held against a pivot that agrees in so many bands; this shapes cost, not results.
AGREEING = 2
#: Names of wanted texts are brought to the texts if they are at most so many, and else the texts to them.
NAMES = 2_000_000
#: So many frequent tokens are told apart by their frequency in the order of tokens; this shapes cost, not results.
FREQUENT = 300_000
#: Sizes travel as their logarithm, in steps of a tenth of a percent.
STEP = np.log(1.001)
SLACK = int(np.log(WHOLE / PART) / STEP) + 2

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_WORD = [_U(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64)) for j in range(WORDS)]
_SYMBOL = np.random.default_rng(4).integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of the base and of its inverse, as far as they were needed."""

    def __init__(self):
        self.forward = self.back = np.ones(1, _U)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.forward):
            size = max(n, 1 << 16)
            out = []
            for base in (_BASE, pow(_BASE, -1, 1 << 64)):
                x = np.full(size, base, _U)
                x[0] = 1
                out.append(np.multiply.accumulate(x))
            self.forward, self.back = out
        return self.forward[:n], self.back[:n]


_powers = _Powers()


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of the five-word shingles, ascending; of the whole if it is shorter; none without words."""
    data = np.frombuffer((text or "").encode().lower(), np.uint8)
    n = len(data)
    space = np.ones(n + 2, bool)
    space[1:-1] = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1])
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return np.zeros(0, _U)
    forward, back = _powers(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(_SYMBOL[data] * forward[:n], out=sums[1:])
    word = _mix((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(_U))
    k = min(WORDS, len(word))
    out = np.full(len(word) - k + 1, k, _U)
    for j in range(k):
        out += word[j : len(word) - k + 1 + j] * _WORD[j]
    return np.unique(_mix(out))


def least_common(n: np.ndarray | int):
    """How many tokens a set of ``n`` has in common with any set it links to, at least."""
    return -(-PART * n // WHOLE)


def _code(n: np.ndarray) -> np.ndarray:
    return np.round(np.log(np.maximum(n, 1)) / STEP).astype("<u2")


def set_id(tokens: np.ndarray) -> int:
    """Names a set by a hash of its tokens."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def _bands(tokens: np.ndarray) -> list[int]:
    bins = BANDS * BAND_ROWS
    at = np.searchsorted(tokens, np.arange(bins, dtype=_U) << _U(64 - 5))
    least = np.where(np.append(at[1:], len(tokens)) > at, tokens[np.minimum(at, len(tokens) - 1)], _U(0)).reshape(BANDS, BAND_ROWS)
    mixed = _mix(least + np.arange(1, BAND_ROWS + 1, dtype=_U) * _U(_BASE))
    return _mix(mixed.sum(1, dtype=_U) + np.arange(BANDS, dtype=_U)).astype(np.int64).tolist()


def _describe(docs: DataFrame) -> DataFrame:
    """doc_id, n, sid and bands of every row, and packed counts of tokens that one batch has more than once."""

    def each(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n", "sid", "bands", "common")}
        seen: dict[int, np.ndarray] = {}
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            tokens = shingles(text)
            sid = set_id(tokens)
            fresh = doc is not None and len(tokens) and sid not in seen
            if fresh:
                seen[sid] = tokens
            row = (doc, len(tokens), sid, _bands(tokens) if fresh else None, None)
            for k, v in zip(out, row):
                out[k].append(v)
        if seen:
            tokens = np.sort(np.concatenate(list(seen.values())))
            begin = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
            count = np.diff(np.append(begin, len(tokens)))
            often = count > 1
            common = [(int(t), int(c)) for t, c in zip(tokens[begin[often]].astype(np.int64), count[often])]
            for i in range(0, len(common), 10_000):
                for k, v in zip(out, (None, -1, None, None, [{"t": t, "c": c} for t, c in common[i : i + 10_000]])):
                    out[k].append(v)
        return out

    return map_batches(docs, each, "doc_id long, n long, sid long, bands array<long>, common array<struct<t:long, c:long>>", at_once=TEXTS_AT_ONCE)


def _frequent(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most FREQUENT tokens, ascending, and their ranks by frequency; all tokens from some frequency on."""
    counts = described.filter("n = -1").select(F.explode("common").alias("x")).groupBy("x.t").agg(F.sum("x.c").alias("c"))
    counts = settle(counts.filter("c >= 8"), "frequent")
    sizes = counts.groupBy(F.floor(F.log2("c") * 4).alias("size")).count().orderBy(F.desc("size")).collect()
    total, least = 0, None
    for r in sizes:
        total += r["count"]
        if total > FREQUENT:
            break
        least = r["size"]
    if least is None:
        return np.zeros(0, _U), np.zeros(0, _U)
    found = counts.filter(F.floor(F.log2("c") * 4) >= least).toArrow()
    token, count = found.column("t").to_numpy().astype(_U), found.column("c").to_numpy()
    order = np.argsort(token)
    token, count = token[order], count[order]
    rank = np.empty(len(token), _U)
    rank[np.lexsort((token, count))] = np.arange(len(token), dtype=_U)
    return token, rank


def _prefix_blocks(ranges: int, frequent: np.ndarray, rank: np.ndarray):
    def first(tokens: np.ndarray) -> np.ndarray:
        key = tokens >> _U(1)
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
            known = frequent[at] == tokens
            key[known] = _U(1 << 63) + rank[at[known]]
        n = len(tokens)
        k = n - least_common(n) + 1
        at = np.argpartition(key, k - 1)[:k] if k < n else np.arange(n)
        return tokens[at[np.argsort(key[at])]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, TEXTS_AT_ONCE):
            sets: dict[int, tuple[int, np.ndarray]] = {}
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                tokens = shingles(text) if doc is not None else ()
                if len(tokens) and (sid := set_id(tokens)) not in sets:
                    sets[sid] = (len(tokens), first(tokens))
            if not sets:
                continue
            sid = np.fromiter(sets, np.int64, len(sets))
            code = _code(np.array([n for n, _ in sets.values()]))
            chosen = [x for _, x in sets.values()]
            token = np.concatenate(chosen)
            owner = np.repeat(np.arange(len(sid)), [len(x) for x in chosen])
            # How far into its set a token stands in the order, in parts of 255, rounded down.
            place = np.concatenate([np.arange(len(x)) * 255 // n for n, x in sets.values()]).astype("u1")
            where = ((token >> _U(32)) % _U(ranges)).astype(np.int64)
            order = np.lexsort((owner, where))
            out = []
            for part in np.split(order, np.flatnonzero(np.diff(where[order])) + 1):
                begin = np.flatnonzero(np.append(True, np.diff(owner[part]) != 0))
                mine = owner[part[begin]]
                out.append((int(where[part[0]]), b"".join((
                    np.int64(len(begin)).tobytes(), sid[mine].tobytes(), code[mine].tobytes(),
                    np.diff(np.append(begin, len(part))).astype("<u4").tobytes(), token[part].astype("<u4").tobytes(),
                    place[part].tobytes(),
                ))))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.binary()))], ["range", "payload"])

    return run


def _shared_tokens(found: pa.Table) -> pa.Table:
    """token, sid, place and weight (tokens of the set that fall together there), where another set of fitting size has the token too."""
    names, codes, tokens, owners, places = [], [], [], [], []
    at = 0
    for payload in (x.as_buffer() for x in found.column("payload")):
        n = int(np.frombuffer(payload, np.int64, 1)[0])
        count = np.frombuffer(payload, "<u4", n, 8 + 10 * n)
        m = int(count.sum())
        names.append(np.frombuffer(payload, np.int64, n, 8))
        codes.append(np.frombuffer(payload, "<u2", n, 8 + 8 * n))
        tokens.append(np.frombuffer(payload, "<u4", m, 8 + 14 * n))
        places.append(np.frombuffer(payload, "u1", m, 8 + 14 * n + 4 * m))
        owners.append(np.repeat(np.arange(at, at + n, dtype="<u4"), count))
        at += n
    # Sets in order of size and name; a set that several batches have is one.
    sid, code = np.concatenate(names), np.concatenate(codes)
    order = np.lexsort((sid, code))
    sid, code = sid[order], code[order]
    new = np.append(True, (sid[1:] != sid[:-1]) | (code[1:] != code[:-1]))
    rank = np.empty(at, "<u4")
    rank[order] = np.cumsum(new) - 1
    # A set has the same tokens in every batch; those of one batch are taken.
    taken = np.zeros(at, bool)
    taken[order[new]] = True
    sid, code = sid[new], code[new].astype(np.int64)
    owner = np.concatenate(owners)
    mine = taken[owner]
    cell = np.concatenate(tokens)[mine].astype(_U)
    cell <<= _U(32)
    cell |= rank[owner[mine]]
    del tokens, owners, owner
    first = np.argsort(cell, kind="stable")
    cell = cell[first]
    new = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
    weight = np.diff(np.append(new, len(cell)))
    cell, first = cell[new], first[new]
    del new
    place = np.concatenate(places)[mine][first]
    del places, first, mine
    token, owner = (cell >> _U(32)).astype(np.int64), cell.astype("<u4")
    near = (token[1:] == token[:-1]) & (code[owner[1:]] - code[owner[:-1]] <= SLACK)
    has = np.append(near, False) | np.append(False, near)
    range_ = found.column("range")[0].as_py() if len(found) else 0
    return pa.table({"token": token[has] | (range_ << 32), "sid": sid[owner[has]], "place": place[has].astype(np.int32), "weight": weight[has].astype(np.int32)})


def _stars(sets: DataFrame) -> DataFrame:
    """a, low and high: each set with the least and the greatest one that it shares a band with, and whether to hold it
    against them: ``low_fits`` and ``high_fits``, if they may link by their sizes and agree in AGREEING bands."""
    bands = sets.select("sid", F.col("n").cast("int").alias("n"), F.explode("bands").alias("band"))
    named = F.struct("sid", "n")
    ends = bands.groupBy("band").agg(F.min(named).alias("first"), F.max(named).alias("last")).filter("first.sid <> last.sid")
    # The least set of all bands is the least one of each band that it has.
    found = bands.join(ends, "band").groupBy(F.col("sid").alias("a")).agg(
        F.first("n").alias("n"), F.min("first").alias("least"), F.max("last").alias("most"),
        F.collect_list("first.sid").alias("firsts"), F.collect_list("last.sid").alias("lasts"),
    )

    def fits(end: str, ends: str) -> Column:
        m, sid = F.col(f"{end}.n"), F.col(f"{end}.sid")
        sizes = (F.col("n") * WHOLE >= m * PART) & (m * WHOLE >= F.col("n") * PART)
        return (F.col("a") != sid) & sizes & (F.size(F.filter(ends, lambda x: x == sid)) >= AGREEING)

    return found.select(
        "a", F.col("least.sid").alias("low"), F.col("most.sid").alias("high"), fits("least", "firsts").alias("low_fits"), fits("most", "lasts").alias("high_fits")
    )


def _tokens_of(docs: DataFrame, sets: DataFrame, needed: DataFrame, short: bool = False) -> DataFrame:
    """sid, n and packed tokens of the needed sets, from the texts of their documents; other texts are not moved.

    ``short`` cuts tokens to 32 bits, which can only raise what two sets seem to have in common.
    """
    wanted = settle(sets.select("doc_id", "sid").join(needed, "sid").select("doc_id", "sid"), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # Repeated rows can stand in several tasks; what reads the tokens takes that.
        for batch in in_slices(batches, TEXTS_AT_ONCE):
            sids, sizes, tokens = [], [], []
            for text, sid in zip(batch.column("text").to_pylist(), batch.column("sid").to_pylist()):
                if sid in seen:
                    continue
                found = shingles(text)
                if set_id(found) == sid:  # else another text under the same id
                    seen.add(sid)
                    sids.append(sid)
                    sizes.append(len(found))
                    tokens.append((np.unique(found.astype("<u4")) if short else found).tobytes())
            columns = [pa.array(sids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["sid", "n", "tokens"])

    # Most texts are not moved in vain; the test is compiled, so that no further Python worker stands beside the one above.
    key = F.xxhash64("doc_id")
    likely = bit_field(wanted.select(key.alias("key"))).has(key)
    few = wanted.count() <= NAMES
    found = docs.filter(F.col("doc_id").isNotNull() & likely).join(F.broadcast(wanted) if few else wanted, "doc_id").select("text", "sid")
    return settle(found.mapInArrow(run, "sid long, n long, tokens binary"), "tokens")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate((a, b))
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _verified(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """The pairs a, b whose sets have the wanted similarity."""
    left = tokens.select(F.col("sid").alias("a"), F.col("tokens").alias("left"))
    right = tokens.select(F.col("sid").alias("b"), F.col("tokens").alias("right"))

    def each(batch: pa.RecordBatch) -> dict:
        good = []
        for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
            a, b = np.frombuffer(x, _U), np.frombuffer(y, _U)
            small, large = sorted((len(a), len(b)))
            if WHOLE * small < PART * large:
                good.append(False)
                continue
            inside = _common(a, b)
            good.append(WHOLE * inside >= PART * (len(a) + len(b) - inside))
        mask = pa.array(good)
        return {name: batch.column(name).filter(mask) for name in ("a", "b")}

    return map_batches(pairs.join(left, "a").join(right, "b"), each, "a long, b long", at_once=PAIRS_AT_ONCE)


def _union(found: pa.Table) -> pa.Table:
    """One row of the matrix for a group: its tokens, cut to 32 bits, those of two members, and the size of its smallest set."""
    union, count = np.unique(np.concatenate([np.frombuffer(x, "<u4") for x in found.column("tokens").to_pylist()]), return_counts=True)
    return pa.table({
        "group": found.column("group")[:1], "least": [min(found.column("n").to_pylist())], "union": [union.tobytes()], "twice": [union[count > 1].tobytes()],
    })


def enough(common: Column, both: Column) -> Column:
    """Whether sets of ``both`` tokens together link by so many common ones."""
    return common * (PART + WHOLE) >= both * PART


def _may_link(n: Column, low: Column, high: Column, shared: Column) -> Column:
    """Whether a set of ``n`` tokens can link to a set of ``low`` to ``high`` tokens, having at most ``shared`` first tokens in common.

    The set whose first tokens end earlier in the order has all
    further common tokens behind them. With m tokens in the other set, (PART + WHOLE) * common >= PART * (n + m) is needed. What
    is behind in the larger set grows faster with m than the need, so the least m and the greatest decide.
    """
    most = F.least(high, F.floor(n * WHOLE / PART))
    smaller = enough(shared + F.ceil(n * PART / WHOLE) - 1, n + low)
    # Without rounding, so that no smaller m allows more.
    larger = (most > n) & ((shared * WHOLE + most * PART - 1) * (PART + WHOLE) >= (n + most) * PART * WHOLE)
    return smaller | larger


def _qualifying(candidates: DataFrame, tokens: DataFrame, unions: DataFrame) -> DataFrame:
    """The candidates (a, group, inside) whose bound allows a link with another member; ``inside`` if a is one itself."""

    def each(batch: pa.RecordBatch) -> dict:
        good = []
        for x, n, y, least in zip(*(batch.column(c).to_pylist() for c in ("tokens", "n", "others", "least"))):
            own = np.frombuffer(x, "<u4")
            # Tokens of one set that fall together in 32 bits count as one; the rest of the set makes up for them.
            bound = _common(own, np.frombuffer(y, "<u4")) + n - len(own)
            good.append((PART + WHOLE) * bound >= PART * (n + max(least, least_common(n))))
        mask = pa.array(good)
        return {name: batch.column(name).filter(mask) for name in ("a", "group")}

    queries = tokens.select(F.col("sid").alias("a"), "n", "tokens")
    others = F.when(F.col("inside"), F.col("twice")).otherwise(F.col("union"))
    asking = candidates.join(queries, "a").join(unions, "group").select("a", "group", "n", "tokens", "least", others.alias("others"))
    return map_batches(asking, each, "a long, group long", at_once=PAIRS_AT_ONCE)


def _links_inside(found: pa.Table) -> pa.Table:
    """Links that connect what the links between asking sets and the members of their group connect.

    The tokens of all members stand in one order, so a set meets all members at once.
    """
    ask = found.column("ask").to_numpy()
    sid = found.column("sid").to_numpy()
    tokens = [np.frombuffer(x, _U) for x in found.column("tokens").to_pylist()]
    members, asking = (x[np.unique(sid[x], return_index=True)[1]] for x in (np.flatnonzero(~ask), np.flatnonzero(ask)))
    token = np.concatenate([tokens[m] for m in members])
    owner = np.repeat(np.arange(len(members)), [len(tokens[m]) for m in members])
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    size = np.array([len(tokens[m]) for m in members])
    names = sid[members]
    root = {int(x): int(x) for x in sid}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a in asking:
        own = tokens[a]
        first, last = np.searchsorted(token, own, "left"), np.searchsorted(token, own, "right")
        n = last - first
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        inside = np.bincount(owner[at], minlength=len(members))
        for m in np.flatnonzero((WHOLE * inside >= PART * (len(own) + size - inside)) & (names != sid[a])).tolist():
            x, y = find(int(sid[a])), find(int(names[m]))
            if x != y:
                root[x] = y
                out.append((int(sid[a]), int(names[m])))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _open(opened: DataFrame, asked: DataFrame, tokens: DataFrame) -> DataFrame:
    """Links between the sets and the members of the groups (a, group) that they open; members are ``asked`` (sid, group).

    A set is brought to a group once, not to each member. A group that very many sets open is laid out several times.
    """
    parts = F.ceil(F.col("n") / ASKING).cast("int").alias("parts")
    counts = settle(opened.groupBy("group").agg(F.count("*").alias("n")).select("group", parts), "openings")
    askers = opened.join(counts, "group").select("group", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("ask"), F.col("a").alias("sid"))
    part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    members = asked.join(counts, "group").select("group", part, F.lit(False).alias("ask"), "sid")
    rows = askers.union(members).join(tokens.select("sid", "tokens"), "sid")
    return rows.groupBy("group", "part").applyInArrow(_links_inside, "a long, b long")


def similarity_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links lead to) of every row.

    Two rows link when the Jaccard similarity of their shingle sets is at least 0.8. Empty sets (null or empty text)
    link with nothing; rows without doc_id have no links and a null component. Repeated rows share a component; two
    texts under one doc_id are two rows. Columns other than doc_id and text are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = settle(_describe(docs), "sets")
    rows = described.filter("n >= 0")
    sets = rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("sid").agg(
        F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("bands").alias("bands")
    )
    frequent, rank = _frequent(described)
    ranges = partitions(docs)
    blocks = docs.mapInArrow(_prefix_blocks(ranges, frequent, rank), "range int, payload binary")
    shared = settle(blocks.groupBy("range").applyInArrow(_shared_tokens, "token long, sid long, place int, weight int"), "shared")
    stars = settle(_stars(sets), "stars")
    to_low = stars.filter("low_fits").select("a", F.col("low").alias("b"))
    to_high = stars.filter("a <> low AND high_fits").select("a", F.col("high").alias("b"))
    ends = to_low.union(to_high)
    tokens = _tokens_of(docs, sets, ends.select(F.col("a").alias("sid")).union(ends.select("b")).distinct())
    low = settle(_verified(to_low, tokens), "star-links")
    rest = to_high.join(low, "a", "left_anti")
    star_links = low.union(settle(_verified(rest, tokens), "star-links"))
    clusters = settle(components(star_links), "clusters")
    # Every set that shares a token, with its cluster and group; a set without links is a cluster of its own, and grouped
    # with others that were drawn to the same pivot. What a set does not ask about is its unit.
    size = F.coalesce("size", F.lit(1))
    sizes = clusters.groupBy("root").agg(F.count("*").alias("size"))
    member = (
        shared.select("sid").distinct()
        .join(sets.select("sid", "n"), "sid")
        .join(clusters.join(sizes, "root").withColumnRenamed("node", "sid"), "sid", "left")
        .select("sid", "n", F.coalesce("root", "sid").alias("cluster"), size.alias("size"))
    )
    member = member.join(stars.select(F.col("a").alias("sid"), F.col("low").alias("pivot")), "sid", "left")
    alone = F.col("size") == 1
    drawn_to = F.when(alone, F.coalesce("pivot", "sid")).otherwise(F.col("cluster"))
    member = settle(member.withColumn("family", drawn_to).drop("pivot"), "families")
    lone = member.filter(alone).groupBy("family").agg(F.count("*").alias("lone"))
    member = member.join(lone, "family", "left")
    block = F.pmod(F.xxhash64("sid"), F.ceil(F.when(alone, F.col("lone")).otherwise(F.col("size")) / GROUP))
    group = F.when(alone & (F.col("lone") == 1), F.col("sid")).otherwise(F.xxhash64("family", "size", block))
    member = member.withColumn("group", group).withColumn("unit", F.when(alone, F.col("group")).otherwise(F.col("cluster")))
    spans = member.groupBy("group").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    member = settle(member.join(spans, "group").select("sid", "n", "cluster", "size", "lone", "group", "unit", "low", "high"), "members")
    # Tokens that more than one cluster has.
    # So many tokens of the set stand at the place of this one or later; before the first common token none is common.
    rest = F.col("n") - F.ceil(F.col("place") * F.col("n") / 255)
    cells = shared.join(member, "sid").withColumn("rest", rest).drop("place")
    wide = cells.groupBy("token").agg(F.min("cluster").alias("x"), F.max("cluster").alias("y")).filter("x <> y").select("token")
    cells = settle(cells.join(wide, "token"), "cells")
    matrix = cells.groupBy("token", "group", F.col("unit").alias("other"), F.col("size").alias("other_size")).agg(
        F.max("rest").alias("other_rest"), F.count("*").alias("holders"), F.first("low").alias("low"), F.first("high").alias("high")
    )
    # The set of the smaller unit asks the groups of the larger one; of sets without links each asks its own group too.
    inside = (F.col("size") == 1) & (F.col("unit") == F.col("other"))
    asks = (F.col("size") < F.col("other_size")) | ((F.col("size") == F.col("other_size")) & (F.col("unit") < F.col("other"))) | (inside & (F.col("lone") > 1))
    fits = (F.col("n") * WHOLE >= F.col("low") * PART) & (F.col("high") * WHOLE >= F.col("n") * PART)
    # In its own group a set meets itself in every token; one that no other member has says nothing.
    fits &= ~inside | (F.col("holders") > 1)
    met = (
        cells.select("token", F.col("sid").alias("a"), "n", "unit", "size", "lone", "rest", "weight").join(matrix, "token").filter(asks & fits)
        .groupBy("a", "group", inside.alias("inside"), "n", "low", "high")
        .agg(F.sum("weight").alias("shared"), F.max(F.least("rest", "other_rest")).alias("rest"))
    )
    met = settle(met.filter(enough(F.col("rest"), F.col("n") + F.col("low"))), "candidates")
    candidates = met.filter(_may_link(*map(F.col, ("n", "low", "high", "shared")))).select("a", "group", "inside")
    asked = settle(member.join(candidates.select("group").distinct(), "group").select("sid", "group"), "asked")
    drawn = asked.select("sid").union(candidates.select("a")).distinct()
    tokens = _tokens_of(docs, sets, drawn, short=True)
    unions = tokens.join(asked, "sid").select("group", "n", "tokens").groupBy("group").applyInArrow(_union, "group long, least long, union binary, twice binary")
    opened = _qualifying(candidates, tokens, unions)
    opened = settle(opened, "opened")
    members = asked.join(opened.select("group").distinct(), "group")
    tokens = _tokens_of(docs, sets, opened.select(F.col("a").alias("sid")).union(members.select("sid")).distinct())
    links = star_links.union(settle(_open(opened, members, tokens), "group-links"))

    roots = settle(components(links), "components").withColumnRenamed("node", "sid")
    named = sets.select("sid", "doc_id").join(roots, "sid")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = roots.join(least, "root").select("sid", "component_id")
    own = sets.select("sid", F.col("doc_id").alias("own_id")).join(linked, "sid", "left").select("sid", F.coalesce("component_id", "own_id").alias("component_id"))
    id_ = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.join(own, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), id_.alias("component_id"))
