"""SentencePiece encoding by sampled segmentations, and decoding.

The pieces of a SentencePiece model span a lattice over each text; a piece of merge rank r has weight
``-alpha * log(r)`` (a Zipf law over the public vocabulary's ranks; nothing is trained). Gumbel top-k draws k distinct
segmentations without replacement: A* search pops the lattice prefix with the largest perturbed score, follows
its best child to the end, and keeps the siblings passed on the way, whose perturbed scores are truncated at
the parent's. The best child of a prefix is an ordinary draw from its conditional distribution, so that walk is
vectorised over all texts of a block; siblings so unlikely that no draw of 53 bits could lift them above those
already held are outside the search by that bound. Every random number is a hash of the row's key, the
sample's number and the place, so a task run again gives the same rows.

Pieces never cross from a non-blank into a blank, so lattices are built once for each distinct word of a block
(with the blanks before it), and a text's lattice is the chain of its words' lattices.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch
from .textkit import U, blocks, lanes, lean, mix, same_spans, span_hashes

ALPHA = 0.5
SAMPLES = 2
SEED = 20_251
BLOCK_BYTES = 1 << 19
BYTE_ZERO = 3
MASK = (1 << 64) - 1
#: exp of -37 is under the least positive value of a 53-bit draw, with a margin.
REACH = 37.5
#: Places of a path with less log prob before them are looked at only if this bound does not rule them out.
DEEP = -60.0


class Vocabulary:
    """Pieces as byte strings with a blank for U+2581, their weights, and tables to look them up by hash."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: list[bytes] = []
        usable = []
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                self.pieces.append(bytes([i - BYTE_ZERO]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.pieces.append(b"")
            else:
                self.pieces.append(sp.id_to_piece(i).replace("▁", " ").encode())
                usable.append(i)
        self.size = len(self.pieces)
        first = min(usable)
        self.byte_weight = -alpha * np.log(self.size + 1.0)
        ids = np.array(usable, np.int64)
        text = [self.pieces[i] for i in usable]
        lengths = np.array([len(t) for t in text])
        # Pieces as numbers of eight bytes; the hash finds a piece, these numbers decide.
        self.words = -(-int(lengths.max()) // 8)
        numbers = np.frombuffer(b"".join(t.ljust(8 * self.words, b"\0") for t in text), "<u8").reshape(len(text), -1)
        hashes = self.key([numbers[:, i] for i in range(self.words)], lengths)
        order = np.argsort(hashes)
        self.hashes, self.ids, self.numbers = hashes[order], ids[order], np.ascontiguousarray(numbers[order].T)
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.weights = -alpha * np.log(self.ids - first + 1.0)
        self.lengths = sorted(set(lengths.tolist()))
        # What an edge weighs and emits: pieces first, then the 256 bytes.
        self.edge_weights = np.concatenate((self.weights, np.full(256, self.byte_weight)))
        self.edge_ids = np.concatenate((self.ids, np.arange(256) + BYTE_ZERO)).astype(np.int32)
        # Lengths that pieces have, by their first bytes: a bit for each, for three bytes by a hash of them.
        self.one, self.two, self.more = np.zeros(256, bool), np.zeros(1 << 16, bool), np.zeros(1 << 16, np.uint64)
        for t in text:
            if len(t) == 1:
                self.one[t[0]] = True
            elif len(t) == 2:
                self.two[t[0] << 8 | t[1]] = True
            else:
                self.more[self.prefix_slot(*np.frombuffer(t[:3], np.uint8).astype(np.uint32)[:, None])] |= np.uint64(1 << len(t))
        # Open addressing on the low bits of the hash.
        self.mask = (1 << 18) - 1
        self.slots = np.full(self.mask + 1, -1, np.int32)
        self.probes = 1
        for i, h in enumerate(self.hashes.tolist()):
            at, tries = h >> 40 & self.mask, 1
            while self.slots[at] >= 0:
                at, tries = (at + 1) & self.mask, tries + 1
            self.slots[at] = i
            self.probes = max(self.probes, tries)

    @staticmethod
    def prefix_slot(a, b, c):
        return ((a << np.uint32(16) | b << np.uint32(8) | c) * np.uint32(0x9E3779B1)) >> np.uint32(16)

    @staticmethod
    def key(numbers, lengths):
        """Hash of spans given as numbers of eight bytes, the last one filled up with zeros."""
        h = np.asarray(lengths).astype(U) * U(0xD6E8FEB86659FD93)
        for x in numbers:
            h = (h ^ x) * U(0x9E3779B97F4A7C15)
            h ^= h >> U(29)
        return h

    def find(self, numbers, n):
        """Index into ids and weights of each span of n bytes, or -1."""
        h = self.key(numbers + [U(0)] * (self.words - len(numbers)), n)
        at = (h >> np.uint64(40)).astype(np.int64) & self.mask
        out = np.full(len(h), -1, np.int32)
        todo = np.arange(len(h), dtype=np.int32)
        for _ in range(self.probes):
            got = self.slots[at[todo]]
            hit = (got >= 0) & (self.hashes[np.maximum(got, 0)] == h[todo])
            out[todo[hit]] = got[hit]
            todo = todo[(got >= 0) & ~hit]
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & self.mask
        found = out >= 0
        for i, x in enumerate(numbers):
            found &= self.numbers[i][out] == x
        out[~found] = -1
        return out


class Lattice:
    """Lattices of the distinct words in ``block``: nodes are byte positions, one end node for each word."""

    def __init__(self, vocab: Vocabulary, block: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        lengths = ends - starts
        total = int(lengths.sum())
        base = np.cumsum(lengths + 1) - (lengths + 1)
        self.root, self.end = base, base + lengths
        # 32-bit arithmetic: a block is far smaller than that, and the arrays are many.
        narrow = np.int32 if len(block) < 1 << 30 else np.int64
        word = np.repeat(np.arange(len(starts), dtype=narrow), lengths)
        flat = np.arange(total, dtype=narrow)
        inner = flat - np.repeat((np.cumsum(lengths) - lengths).astype(narrow), lengths)
        pos, node, left = starts.astype(narrow)[word] + inner, flat + word, lengths.astype(narrow)[word] - inner
        first = block[pos]
        wide = np.concatenate((block, np.zeros(2, np.uint8)))
        second, third = wide[pos + 1].astype(np.uint32), wide[pos + 2].astype(np.uint32)
        lead_byte = first.astype(np.uint32)
        more = np.where(left > 2, vocab.more[vocab.prefix_slot(lead_byte, second, third)], np.uint64(0))
        two = (left > 1) & vocab.two[lead_byte << np.uint32(8) | second]
        begins = (first & 0xC0) != 0x80
        eight = lanes(block)
        # Edges as start node, length, and index of the piece; bytes have the indices behind the pieces.
        src, size, piece = [], [], []
        # Bytes stand in for characters that are no piece; every byte of such a character is an edge.
        char_len = np.where(first < 0x80, 1, np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4))).astype(np.int32)
        char_len = np.minimum(char_len, left)
        known = np.zeros(total, bool)
        for n in vocab.lengths:
            at = np.flatnonzero(begins & (vocab.one[first] if n == 1 else two if n == 2 else (left >= n) & (more >> np.uint64(n) & np.uint64(1)).astype(bool)))
            if not len(at):
                continue
            numbers = [eight[pos[at] + i] for i in range(0, n, 8)]
            if n % 8:
                numbers[-1] &= np.uint64((1 << 8 * (n % 8)) - 1)
            got = vocab.find(numbers, n)
            at, got = at[got >= 0], got[got >= 0]
            known[at[char_len[at] == n]] = True
            src.append(node[at])
            size.append(np.full(len(at), n, np.uint8))
            piece.append(got)
        lead = np.flatnonzero(begins & ~known)
        raw = np.concatenate([lead[char_len[lead] > k] + k for k in range(4)]) if len(lead) else lead
        # Bytes that lead no character (not possible in UTF-8) would leave gaps: they are edges as well.
        raw = np.concatenate((raw, np.flatnonzero(~begins & (inner == 0))))
        src.append(node[raw])
        size.append(np.ones(len(raw), np.uint8))
        piece.append(len(vocab.ids) + first[raw].astype(np.int32))
        src, size, piece = (np.concatenate(x) for x in (src, size, piece))
        nodes = total + len(starts)
        away = np.zeros(nodes, np.int32)
        away[node] = left
        del word, inner, pos, node, left, first, more, two, begins, known, char_len, flat, second, third, lead_byte
        # One order for all: nearest to the word's end first, then by node, long pieces first.
        order = np.argsort((away[src].astype(np.int64) << 38) + (src.astype(np.int64) << 6) - size)
        src, size, piece = src[order], size[order], piece[order]
        del order
        dst = src + size
        wgt = vocab.edge_weights[piece]
        new = np.flatnonzero(np.concatenate(([True], src[1:] != src[:-1]))) if len(src) else np.zeros(0, np.int64)
        size = np.diff(np.append(new, len(src)))
        heads = src[new]
        self.first, self.degree = np.zeros(nodes, np.int32), np.zeros(nodes, np.int32)
        self.first[heads], self.degree[heads] = new, size
        self.group_node = heads
        # Backward log sums, level by level; every node of an edge has a way to the end.
        back = np.zeros(nodes)
        far = away[heads]
        cuts = np.concatenate((np.flatnonzero(np.concatenate(([True], far[1:] != far[:-1]))), [len(new)])) if len(new) else np.zeros(1, np.int64)
        edge_cut = np.append(new, len(src))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            a, b = edge_cut[i], edge_cut[j]
            v = wgt[a:b] + back[dst[a:b]]
            at = new[i:j] - a
            top = np.maximum.reduceat(v, at)
            v -= np.repeat(top, size[i:j])
            back[heads[i:j]] = top + np.log(np.add.reduceat(np.exp(v), at))
        self.dst, self.pid = dst.astype(np.int32), vocab.edge_ids[piece]
        self.logp = wgt + back[dst] - back[src]
        whole = np.cumsum(np.exp(self.logp))
        self.upto = whole - np.repeat(np.concatenate(([0.0], whole))[new], size)
        self.upto[new + size - 1] = 2.0
        self.heads = new

    def src_of(self, edges: np.ndarray) -> np.ndarray:
        """Node that each edge leaves."""
        return self.group_node[np.searchsorted(self.heads, edges, "right") - 1]

    def walk(self, node: np.ndarray, stop: np.ndarray, draw):
        """Sample from each start node to its stop: yields (index, edge) step by step; draw(index, step) gives uniforms."""
        live = np.flatnonzero(node != stop)
        node, step = node[live], 0
        while len(live):
            u = draw(live, step)
            edge = self.first[node]
            todo = np.flatnonzero(u >= self.upto[edge])
            while len(todo):
                edge[todo] += 1
                todo = todo[u[todo] >= self.upto[edge[todo]]]
            yield live.astype(np.int32), edge
            node = self.dst[edge]
            on = node != stop[live]
            live, node = live[on], node[on]
            step += 1


def _uniform(key):
    """Uniforms in (0, 1) from 64-bit keys."""
    return ((mix(key) >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def _log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x))), the log probability that a Gumbel of location x is over 0."""
    return x if x < -30 else 0.0 if x > 6 else float(np.log(-np.expm1(-np.exp(x))))


def _chunks(offsets, block):
    """Text with a blank before each row that is not empty, cut into words with the blanks before them and line feeds."""
    lengths = np.diff(offsets)
    filled = lengths > 0
    text = np.insert(block, offsets[:-1][filled], 0x20)
    edge = offsets + np.concatenate(([0], np.cumsum(filled)))
    if not len(text):
        return edge, text, *(np.zeros(0, np.int64),) * 3
    blank, feed = text == 0x20, text == 0x0A
    head = np.zeros(len(text), bool)
    head[edge[:-1][filled]] = True
    head[1:] |= (blank[1:] & ~blank[:-1]) | feed[1:] | feed[:-1]
    starts = np.flatnonzero(head)
    ends = np.append(starts[1:], len(text))
    return edge, text, starts, ends, np.searchsorted(edge, starts, "right") - 1


def sample_block(vocab: Vocabulary, keys: np.ndarray, offsets: np.ndarray, block: np.ndarray, k: int):
    """For each row, up to k samples in order of perturbed score: (ids, log_prob, perturbed, log_inclusion).

    A row with fewer than k segmentations gives them all, each with log_inclusion 0.
    """
    n = len(offsets) - 1
    edge_of, text, starts, ends, row = _chunks(offsets, block)
    _, example, kind = np.unique(span_hashes(text, starts, ends - starts), return_index=True, return_inverse=True)
    same = (ends - starts == (ends - starts)[example][kind]) if len(starts) else np.zeros(0, bool)
    same[same] = same_spans(text, starts[same], starts[example][kind[same]], (ends - starts)[same])
    alone = np.flatnonzero(~same)  # words that only share a hash with another: kinds of their own
    kind[alone] = len(example) + np.arange(len(alone))
    example = np.concatenate((example, alone))
    lat = Lattice(vocab, text, starts[example], ends[example])
    del text
    root, stop = lat.root[kind], lat.end[kind]
    inner = (starts - edge_of[row]).astype(U)
    row_first = np.searchsorted(row, np.arange(n + 1))
    seed = mix(keys.view(U) + U(SEED))
    del kind, starts, ends

    def place(chunk, step, sample):
        return mix(seed[row[chunk]] + U((sample + 1) * 0x9E3779B97F4A7C15 & MASK)) + inner[chunk] * U(0xBF58476D1CE4E5B9) + U(step)

    results: list[list] = [[] for _ in range(n)]
    # Open parts of the search, each the siblings passed at one place of a path but for those already taken from it:
    # (perturbed score of the best of them, log prob before the place, path, place, edges taken).
    held: list[list] = [[] for _ in range(n)]
    none = (np.zeros(0, np.int32), np.zeros(0, np.int32))
    for r in np.flatnonzero(row_first[1:] == row_first[:-1]).tolist():
        results[r].append((none[0], 0.0, 0.0))
    rows = np.flatnonzero(row_first[1:] > row_first[:-1])
    chunk_ids, begin = np.arange(len(root), dtype=np.int32), root
    heads, base, gumbel = {}, np.zeros(len(rows)), -np.log(-np.log(_uniform(seed[rows])))
    for sample in range(k):
        if sample:
            picked = [(r, x) for r in rows.tolist() if (x := _pop(lat, held[r], seed[r], sample)) is not None]
            if not picked:
                break
            rows = np.array([r for r, _ in picked])
            heads = {r: x[2] for r, x in picked}
            gumbel, base = np.array([x[0] for _, x in picked]), np.array([x[1] for _, x in picked])
            parts = [np.arange(x[2][1][-1], row_first[r + 1], dtype=np.int32) for r, x in picked]
            chunk_ids = np.concatenate(parts)
            begin = root[chunk_ids]
            begin[np.cumsum([0, *(len(p) for p in parts[:-1])])] = [lat.dst[x[2][0][-1]] for _, x in picked]
        steps = list(lat.walk(begin, stop[chunk_ids], lambda i, s, c=chunk_ids, j=sample: _uniform(place(c[i], s, j))))
        count = np.zeros(len(chunk_ids), np.int32)
        for i, _ in steps:
            count[i] += 1
        offset = np.cumsum(count, dtype=np.int64) - count
        edges = np.empty(int(count.sum()), np.int32)
        for s, (i, e) in enumerate(steps):
            edges[offset[i] + s] = e
        del steps
        chunk_at = np.repeat(chunk_ids, count)
        logp, pids = lat.logp[edges], lat.pid[edges]
        cut = np.append(np.append(offset, len(edges))[np.searchsorted(row[chunk_ids], rows)], len(edges))
        total = np.concatenate(([0.0], np.cumsum(logp)))
        own = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(cut))
        past = total[:-1] - (total[cut[:-1]] - base)[own]
        ends_at = base + total[cut[1:]] - total[cut[:-1]]
        del total
        # Best perturbed score among the siblings at each place, truncated at the path's own; the places behind the
        # least log prob that a draw could lift over what a row holds are left out, row by row.
        want = k - sample
        near = np.flatnonzero(past > DEEP)
        found = _places(lat, edges, chunk_at, logp, past, own, near, root, cut, gumbel, seed[rows], sample)
        order = np.lexsort((-found[1], own[found[0]]))
        at, value = found[0][order], found[1][order]
        first = np.searchsorted(own[at], np.arange(len(rows) + 1))
        for j, r in enumerate(rows.tolist()):
            lo, hi = int(cut[j]), int(cut[j + 1])
            head = heads.get(r, none)
            path = (head, edges[lo:hi], chunk_at[lo:hi])
            ids = np.concatenate((lat.pid[head[0]], pids[lo:hi])) if sample else pids[lo:hi]
            results[r].append((ids, float(ends_at[j]), float(gumbel[j])))
            a, b = int(first[j]), int(first[j + 1])
            new = [(float(value[x]), float(past[at[x]]), path, int(at[x]) - lo, (int(edges[at[x]]),)) for x in range(a, min(b, a + want))]
            best = sorted(held[r] + new, key=lambda x: -x[0])[:want]
            floor = best[-1][0] if len(best) == want else -np.inf
            if hi > lo and past[hi - 1] <= DEEP and DEEP + REACH >= floor:  # hardly ever: look at the rest as well
                rest = lo + np.flatnonzero(past[lo:hi] <= DEEP)
                more = _places(lat, edges, chunk_at, logp, past, own, rest, root, cut, gumbel, seed[rows], sample)
                new = [(float(v), float(past[i]), path, int(i) - lo, (int(edges[i]),)) for i, v in zip(*more, strict=True)]
                best = sorted(best + new, key=lambda x: -x[0])[:want]
            held[r] = best
    for r in range(n):
        limit = max((x[0] for x in held[r]), default=-np.inf)
        results[r] = [(ids, lp, g, _log_inclusion(lp - limit)) for ids, lp, g in results[r]]
    return results


def _places(lat, edges, chunk_at, logp, past, own, at, root, cut, gumbel, seeds, sample):
    """(places, scores) for those of ``at`` where a path passed siblings."""
    node = root[chunk_at[at]]
    same = np.flatnonzero((at > 0) & (chunk_at[np.maximum(at, 1) - 1] == chunk_at[at]) & (own[np.maximum(at, 1) - 1] == own[at]))
    node[same] = lat.dst[edges[at[same] - 1]]
    if sample:  # a resumed walk begins within its first word
        begins = np.flatnonzero(at == cut[own[at]])
        node[begins] = lat.src_of(edges[at[begins]])
    some = lat.degree[node] > 1
    at = at[some]
    with np.errstate(divide="ignore"):
        phi = past[at] + np.log(-np.expm1(np.minimum(logp[at], 0.0)))
    key = mix(seeds[own[at]] + U((sample + 1) * 0xD6E8FEB86659FD93 & MASK)) + (at - cut[own[at]]).astype(U) * U(0x94D049BB133111EB)
    return at, -np.logaddexp(-gumbel[own[at]], np.log(-np.log(_uniform(key))) - phi)


def _pop(lat, held, seed, sample):
    """Take the best open part: (perturbed score, log prob, prefix of edges and words); what is left of it stays open."""
    if not held:
        return None
    best = max(held, key=lambda x: x[0])
    held.remove(best)
    g, before, (head, edges, chunks), at, taken = best
    node = lat.src_of(edges[at : at + 1])[0]
    options = np.arange(lat.first[node], lat.first[node] + lat.degree[node])
    options = options[~np.isin(options, taken)]
    weight = np.exp(lat.logp[options])
    key = np.array([int(seed) + (sample + 1) * 0xA24BAED4963EE407 + at * 0x9FB21C651E98DF25 & MASK], U)
    draw = _uniform(np.concatenate((key, key + U(1))))
    e = int(options[min(np.searchsorted(np.cumsum(weight), draw[0] * weight.sum(), "right"), len(options) - 1)])
    rest = float(weight[options != e].sum())
    if len(options) > 1 and rest > 0:
        left = -np.logaddexp(-g, np.log(-np.log(draw[1])) - before - np.log(rest))
        held.append((float(left), before, (head, edges, chunks), at, (*taken, e)))
    prefix = (np.concatenate((head[0], edges[:at], [e])).astype(np.int32), np.concatenate((head[1], chunks[: at + 1])).astype(np.int32))
    return g, before + float(lat.logp[e]), prefix


def _encoder(id_col, text_col, model_path, k, alpha, digest):
    def run(batches):
        vocab = Vocabulary(model_path, alpha)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(id_col))
            for first, offsets, block in blocks(batch, text_col, 4096, BLOCK_BYTES):
                own = ids.slice(first, len(offsets) - 1).cast(pa.int64())
                found = sample_block(vocab, own.fill_null(-1).to_numpy(), offsets, block, k)
                flat = [(r, j, *x) for r, own_samples in enumerate(found) for j, x in enumerate(own_samples)]
                cols = [own.take(pa.array([x[0] for x in flat], pa.int64())), pa.array([x[1] + 1 for x in flat], pa.int32()), pa.array([len(x[2]) for x in flat], pa.int64())]
                if digest:
                    view = memoryview(block)
                    same = [decode(vocab.pieces, x[2]) == bytes(view[offsets[x[0]] : offsets[x[0] + 1]]) for x in flat]
                    cols += [pa.array([hashlib.sha256(x[2].astype("<i4").tobytes()).hexdigest() for x in flat]), pa.array(same)]
                else:
                    cut = np.cumsum([0] + [len(x[2]) for x in flat])
                    cols.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *(x[2] for x in flat)]))))
                cols += [pa.array([x[c] for x in flat], pa.float64()) for c in (3, 4, 5)]
                yield pa.RecordBatch.from_arrays(cols, [id_col, "sample", "n_pieces", *(["ids_sha256", "round_trip"] if digest else ["ids"]), "log_prob", "perturbed", "log_inclusion"])

    return run


def decode(pieces: list[bytes], ids) -> bytes:
    """UTF-8 bytes of a sequence of piece ids: pieces joined, the blank that encoding put in front taken off."""
    out = b"".join(map(pieces.__getitem__, ids.tolist() if hasattr(ids, "tolist") else ids))
    return out[1:] if out[:1] == b" " else out


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", k: int = SAMPLES, alpha: float = ALPHA, digest: bool = False) -> DataFrame:
    """k distinct sampled segmentations of each text: id, sample (from 1, best perturbed score first), n_pieces, ids,
    log_prob, perturbed, log_inclusion.

    ``log_inclusion`` is the log of the probability that the segmentation has a perturbed score over the best one left out. With
    ``digest`` the ids are replaced by ids_sha256 (of little-endian 32-bit ids) and round_trip (decoding gives the
    text back). A text with fewer than k segmentations gives all it has, with log_inclusion 0. A null or empty text has
    one segmentation, the empty one. Rows that share id and text give the same samples; a null id seeds like -1.
    Characters that are no piece become bytes. An empty table gives an empty result.
    """
    own = [T.StructField("ids_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType())] if digest else [T.StructField("ids", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("sample", T.IntegerType()), T.StructField("n_pieces", T.LongType()), *own, *(T.StructField(c, T.DoubleType()) for c in ("log_prob", "perturbed", "log_inclusion"))])
    scratch.bounded_batches(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(lean(_encoder(id_col, text_col, model_path, k, alpha, digest)), schema)


def decode_ids(samples: DataFrame, model_path: str, ids_col: str = "ids", name: str = "text") -> DataFrame:
    """``samples`` with the decoded text of an array of ids; null ids give null, empty ids the empty text."""

    def run(batches):
        pieces = Vocabulary(model_path, ALPHA).pieces
        for batch in batches:
            texts = [None if x is None else decode(pieces, x).decode("utf-8", "replace") for x in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, name])

    return samples.mapInArrow(run, T.StructType([*samples.schema.fields, T.StructField(name, T.StringType())]))


def default_model() -> str:
    """The public model's path; a parameter everywhere else."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
