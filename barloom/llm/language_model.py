"""Scores of research reports under a smoothed n-gram model learnt from the corpus.

The model is a weighted automaton: a root state whose arcs are words, a state
for every word seen in learning whose arcs are the pairs that begin with it,
and a failure arc from each word state to the root.  It is never gathered in
one place: blocks of reports ask the ranges of a hash for the counts of just
the words and pairs they hold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import any_key, byte_view, mix, slices, stored, word_hashes

#: Bytes of text in a block, bytes of text for each range, and the least number of blocks.
BLOCK, RANGE, LEAST = 1 << 23, 1 << 23, 32

#: Weight of the word distribution within that of a state, in words.
PRIOR = 200.0

_END, _START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


#: Bytes of a pair's hash that are sent: with its range they stand for all eight.
PAIR_BYTES = 6


def _pack(keys: np.ndarray, words: bool) -> bytes:
    raw = keys.astype("<u8").view(np.uint8).reshape(-1, 8)
    return (raw if words else raw[:, :PAIR_BYTES]).tobytes()


def _unpack(data: bytes, words: bool) -> np.ndarray:
    if words:
        return np.frombuffer(data, "<u8")
    raw = np.frombuffer(data, np.uint8).reshape(-1, PAIR_BYTES)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :PAIR_BYTES] = raw
    return out.view("<u8").ravel()


class Block:
    """Tokens of a group of reports: distinct words and pairs, and each token's place in them."""

    def __init__(self, reports: pa.Table):
        data, offsets = byte_view(reports.column("report"))
        parts, counts = [], []
        for lo, hi in slices(offsets):
            hashes, first = word_hashes(data, offsets[lo : hi + 1], fold_case=True)
            ends = np.insert(hashes, first[1:], _END)
            parts.append(ends)
            counts.append(np.diff(first) + 1)
        self.n = np.concatenate(counts)
        token = np.concatenate(parts)
        self.begin = np.concatenate([[0], np.cumsum(self.n)[:-1]])
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[self.begin] = _START
        with np.errstate(over="ignore"):
            pair = mix(before * np.uint64(0x9E3779B97F4A7C15) + token * np.uint64(0xC2B2AE3D27D4EB4F))
        self.words, self.word_at = np.unique(token, return_inverse=True)
        self.pairs, self.pair_at = np.unique(pair, return_inverse=True)
        learn = reports.column("learn").combine_chunks().fill_null(False).to_numpy(zero_copy_only=False)
        self.learnt = np.repeat(learn.astype(bool), self.n)

    def requests(self, block: int, word_ranges: int, pair_ranges: int) -> pa.Table:
        rows = []
        for keys, at, ranges, base in (
            (self.words, self.word_at, word_ranges, 0), (self.pairs, self.pair_at, pair_ranges, word_ranges),
        ):
            count = np.bincount(at[self.learnt], minlength=len(keys)).astype("<u4")
            place = ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            for lo, hi in zip(cuts, [*cuts[1:], len(keys)]):
                rows.append((
                    block, base + int(place[lo]), base == 0, _pack(keys[lo:hi], base == 0), count[lo:hi].tobytes()
                ))
        types = (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
        return pa.Table.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), types)], ["block", "range", "is_word", "keys", "counts"]
        )


def _sum_range(rows: pa.Table) -> pa.Table:
    """The corpus counts of one range, given back to each block in its own order."""
    words = rows.column("is_word")[0].as_py()
    keys = [_unpack(x, words) for x in rows.column("keys").to_pylist()]
    counts = [np.frombuffer(x, "<u4") for x in rows.column("counts").to_pylist()]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, np.concatenate(counts).astype(np.float64), len(distinct)).astype("<u8")
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    n = len(keys)
    return pa.table({
        "block": rows.column("block"),
        "range": rows.column("range"),
        "counts": pa.array([x.tobytes() for x in np.split(total[at], cuts)], pa.binary()),
        "tokens": pa.array([int(total.sum()) if words and i == 0 else 0 for i in range(n)], pa.int64()),
        "kinds": pa.array([int((total > 0).sum()) if words and i == 0 else 0 for i in range(n)], pa.int64()),
    })


def traverse(
    block: Block, word_count: np.ndarray, pair_count: np.ndarray, total: int, kinds: int, prior: float = PRIOR
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Known tokens, base score and model score of every report of a block.

    The state after a token is that of its word, or the root for a word not
    learnt.  A seen pair takes the state's own arc; otherwise the failure arc is
    paid and the root's arc taken.
    """
    c = word_count[block.word_at].astype(np.float64)
    root = (c + 0.5) / (total + 0.5 * (kinds + 1))
    state = np.empty_like(c)
    state[1:] = c[:-1]
    ends = float(word_count[np.searchsorted(block.words, _END)])
    state[block.begin] = ends  # as many reports begin as end
    seen = pair_count[block.pair_at].astype(np.float64)
    own_arc = np.log10((seen + prior * root) / (state + prior))
    failure = np.log10(prior / (state + prior))
    step = np.where(seen > 0, own_arc, failure + np.log10(root))
    return (
        np.add.reduceat((c > 0).astype(np.int64), block.begin),
        np.add.reduceat(np.log10(root), block.begin),
        np.add.reduceat(step, block.begin),
    )


@any_key("report_id")
def score_reports(reports: DataFrame) -> DataFrame:
    """Log10 probabilities of reports ``(report_id, report, learn)``.

    The model learns from rows whose ``learn`` is true.  Tokens are words (runs
    without blanks, A-Z as a-z) and one end for each report.  Returns
    ``report_id, n_tokens, n_known`` (tokens seen in learning), ``train_tokens``,
    ``base_score`` (add-a-half unigrams) and ``score``, the probability under
    the automaton, where a state of count ``c`` gives a word
    ``(pairs + PRIOR * root) / (c + PRIOR)``: it sums to one over all words.

    * A null or empty report is just its end.  A null ``learn`` is false.
    * Without rows to learn from, counts are zero and base scores follow.
    * All counts are sums over the whole corpus, words by 64-bit hashes and pairs
      by 48 bits within a range of hashes; what is exchanged grows with the text
      and no task holds the whole model.
    * Repeated rows are each scored (and each learnt from); an empty table
      gives an empty result; other columns are ignored.
    """
    rows = reports.select(
        F.col("report_id").cast("bigint"), F.coalesce(F.col("report").cast("string"), F.lit("")).alias("report"),
        F.coalesce("learn", F.lit(False)).alias("learn"),
    )
    size = rows.agg(F.sum(F.octet_length("report").cast("bigint"))).first()[0] or 0
    blocks, pair_ranges = max(LEAST, -(-size // BLOCK)), max(LEAST, -(-size // RANGE))
    word_ranges = max(LEAST // 4, pair_ranges // 4)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("report_id", "report"), F.lit(blocks)))

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        return Block(table).requests(key[0].as_py(), word_ranges, pair_ranges)

    answers = stored(
        rows.groupBy("block")
        .applyInArrow(ask, "block bigint, range bigint, is_word boolean, keys binary, counts binary")
        .groupBy("range")
        .applyInArrow(_sum_range, "block bigint, range bigint, counts binary, tokens bigint, kinds bigint")
    )
    totals = answers.agg(F.sum("tokens"), F.sum("kinds")).first()
    total, kinds = totals[0] or 0, totals[1] or 0

    def score(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in out})
        block = Block(table)
        order = np.argsort(replies.column("range").to_numpy())
        parts = replies.column("counts").to_pylist()
        counts = np.concatenate([np.frombuffer(parts[i], "<u8") for i in order])
        known, base, model = traverse(
            block, counts[: len(block.words)], counts[len(block.words) :], total, kinds
        )
        return pa.table(
            [table.column("report_id").combine_chunks(), pa.array(block.n, pa.int64()), pa.array(known, pa.int64()),
             pa.array(np.full(len(base), total), pa.int64()), pa.array(base), pa.array(model)],
            schema=out,
        )

    out = pa.schema([
        ("report_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
    ])
    return rows.groupBy("block").cogroup(answers.select("block", "range", "counts").groupBy("block")).applyInArrow(
        score, "report_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    )
