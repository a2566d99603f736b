"""Language identification by a linear-chain conditional random field over words.

Every word has a label. Its emission scores are sums of learned weights of hashed features:
the word itself (lexicon), its affixes, and its letter trigrams. Learned transitions tie
neighbours, so a passage in another language inside a text shows as a run of other labels.
Forward-backward gives each word's distribution over the languages; a text's language is
the one with the largest mean, and that mean is the score.

Defined cases: a null text, an empty one and one without a letter give ``und`` with score 0;
ties go to the language that sorts first; a text of any length is decoded whole, in blocks
whose transfer matrices are chained exactly; repeated rows each give a row; without any
usable training row every text is ``und``; an empty table gives an empty one; columns of the
names of the prediction and the score are replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skein.llm.shared import small_batches
from skein.llm.textscan import ALPHA, Scan, mix, slices, texts_of

#: Hashed features, and words in a block of the chain.
BUCKETS, BLOCK = 1 << 17, 32
#: Labelled rows a language that the model is fitted to, and the longest text among them (a documented bound).
SAMPLE_ROWS, SAMPLE_CHARS = 150, 3000
#: Values of lang that are learned, the most frequent ones (a documented bound, so that junk labels cannot grow the model).
LANGUAGES = 100
UNKNOWN = "und"


def features(scan: Scan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per-word features (words x 5), per-byte trigram features, and how many trigrams end before each byte."""
    start, end, n = scan.start, scan.end, len(scan.data)
    fixed = [scan.hash_spans(start, end)]
    for k in (2, 3):
        fixed.append(mix(scan.hash_spans(start, np.minimum(start + k, end)) + np.uint64(k)))
        fixed.append(mix(scan.hash_spans(np.maximum(end - k, start), end) + np.uint64(16 + k)))
    d = scan.data.astype(np.uint32)
    tri = np.zeros(n, np.int64)
    if n >= 3:
        tri[2:] = ((d[:-2] * np.uint32(961_748_927) + d[1:-1] * np.uint32(86_028_121) + d[2:] * np.uint32(2_654_435_761)) >> np.uint32(8)) % BUCKETS
    return np.stack([(f % np.uint64(BUCKETS)).astype(np.int64) for f in fixed], 1), tri, n


def emissions(scan: Scan, weights: np.ndarray) -> np.ndarray:
    """Scores of each word for each label: the weights of its features, averaged over its trigrams."""
    fixed, tri, n = features(scan)
    out = weights[fixed].sum(1, dtype=np.float64)
    for k in range(weights.shape[1]):
        total = np.zeros(n + 1)
        np.cumsum(weights[tri, k], out=total[1:])
        inside = np.minimum(scan.start + 2, scan.end)
        out[:, k] += (total[scan.end] - total[inside]) / np.maximum(1, scan.end - inside)
    return out


def posteriors(scores: np.ndarray, first: np.ndarray, move: np.ndarray, begin: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Each word's distribution over the labels, by forward-backward over all chains at once.

    first: where each chain begins in scores, and the end. Chains are cut into blocks; the product of
    a block's matrices carries the state across it, so no step depends on a chain's whole length.
    pairs: if given, the expected counts of neighbouring labels are added to it.
    """
    n, k = scores.shape
    if not n:
        return np.zeros((0, k))
    local = np.exp(np.maximum(scores - scores.max(1, keepdims=True), -30))
    counts = np.diff(first)
    blocks = -(-counts // BLOCK)
    block_at = np.concatenate([[0], np.cumsum(blocks)])
    nb = int(block_at[-1])
    at = np.arange(n) - np.repeat(first[:-1], counts)
    row, col = np.repeat(block_at[:-1], counts) + at // BLOCK, at % BLOCK
    e = np.ones((BLOCK, nb, k))
    e[col, row] = local
    there = np.zeros((BLOCK, nb), bool)
    there[col, row] = True
    # transfer of each block, rows: label before it, columns: label of its last word
    carry = np.broadcast_to(np.eye(k), (nb, k, k)).copy()
    for t in range(BLOCK):
        step = (carry.reshape(-1, k) @ move).reshape(nb, k, k) * e[t][:, None, :]
        carry = np.where(there[t][:, None, None], step, carry)
        if t % 8 == 7:
            carry /= carry.sum((1, 2), keepdims=True)
    enter, leave = np.zeros((nb, k)), np.ones((nb, k))
    order = np.argsort(-blocks, kind="stable")
    sizes = blocks[order]
    ahead, back = np.broadcast_to(begin @ np.linalg.pinv(move), (len(blocks), k)).copy(), np.ones((len(blocks), k))
    for s in range(int(sizes[0])):
        live = order[: np.searchsorted(-sizes, -s, "left")]
        b = block_at[live] + s
        enter[b] = ahead[live]
        x = np.einsum("ni,nij->nj", ahead[live], carry[b])
        ahead[live] = x / np.abs(x).sum(1, keepdims=True)
        b = block_at[live + 1] - 1 - s
        leave[b] = back[live]
        x = np.einsum("nij,nj->ni", carry[b], back[live])
        back[live] = x / x.sum(1, keepdims=True)
    alpha, a = np.empty((BLOCK, nb, k)), enter
    for t in range(BLOCK):
        step = (a @ move) * e[t]
        step /= np.maximum(step.sum(1, keepdims=True), 1e-300)
        a = np.where(there[t][:, None], step, a)
        alpha[t] = a
    beta, z = np.empty((BLOCK, nb, k)), leave
    for t in range(BLOCK - 1, -1, -1):
        beta[t] = z
        step = (z * e[t]) @ move.T
        step /= np.maximum(step.sum(1, keepdims=True), 1e-300)
        z = np.where(there[t][:, None], step, z)
    both = np.maximum(alpha[col, row] * beta[col, row], 1e-300)
    if pairs is not None:
        inner = np.flatnonzero(at > 0)
        after = (e[col, row] * beta[col, row])[inner]
        before = alpha[col, row][inner - 1]
        joint = before[:, :, None] * move[None] * after[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    return both / both.sum(1, keepdims=True)


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # hashed features x labels
    move: np.ndarray  # transitions, as factors
    begin: np.ndarray

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean distribution of the words of each text; a row of zeros for a text without words."""
        scan = Scan(data, offsets, ALPHA)
        if not len(scan.start):
            return np.zeros((len(offsets) - 1, len(self.labels)))
        p = posteriors(emissions(scan, self.weights), scan.first, self.move, self.begin)
        out = np.stack([np.bincount(scan.text, p[:, k], len(offsets) - 1) for k in range(len(self.labels))], 1)
        return out / np.maximum(scan.counts, 1)[:, None]


def fit(texts: list[str], langs: list[str], rounds: int = 14, step: float = 0.5) -> Model | None:
    """Fit the chain's likelihood by gradient ascent with adaptive steps.

    Texts of one language teach staying; for switching, texts are also spliced: every fourth chain is
    followed without a break by one of another language.
    """
    labels = sorted({x for x in langs})
    if not labels:
        return None
    k, rng = len(labels), np.random.default_rng(7)
    order = rng.permutation(len(texts))
    texts, langs = [texts[i] for i in order], [langs[i] for i in order]
    column = pa.array(texts, pa.string())
    data, offsets = texts_of(column)
    scan = Scan(data, offsets, ALPHA)
    if not len(scan.start):
        return None
    truth = np.array([labels.index(x) for x in langs])[scan.text]
    keep = np.ones(len(scan.first), bool)
    keep[1:-1] = np.arange(1, len(scan.first) - 1) % 4 != 0
    chains = scan.first[keep]
    chains = np.concatenate([chains[:-1][np.diff(chains) > 0], chains[-1:]])
    fixed, tri, n = features(scan)
    inside = np.minimum(scan.start + 2, scan.end)
    lengths = scan.end - inside
    owner = np.repeat(np.arange(len(lengths)), lengths)
    places = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(inside, lengths)
    ids = np.concatenate([fixed.ravel(), tri[places]])
    words = np.concatenate([np.repeat(np.arange(len(fixed)), fixed.shape[1]), owner])
    value = np.concatenate([np.ones(fixed.size), 1 / np.maximum(1, lengths)[owner]])
    seen, ids = np.unique(ids, return_inverse=True)
    weights, speed = np.zeros((len(seen), k)), np.full((len(seen), k), 1e-2)
    log_move, move_speed = np.where(np.eye(k, dtype=bool), 2.0, -1.0), np.full((k, k), 1e-2)
    real = np.zeros((k, k))
    follow = np.ones(len(truth), bool)
    follow[chains[:-1]] = False
    np.add.at(real, (truth[:-1][follow[1:]], truth[1:][follow[1:]]), 1)
    onehot, begin = np.eye(k)[truth], np.full(k, 1 / k)
    balance = (len(truth) / k / np.maximum(1, np.bincount(truth, minlength=k)))[truth][:, None]
    for _ in range(rounds):
        scores = np.stack([np.bincount(words, weights[ids, j] * value, len(fixed)) for j in range(k)], 1)
        pairs = np.zeros((k, k))
        gap = (onehot - posteriors(scores, chains, np.exp(log_move), begin, pairs)) * balance
        grad = np.stack([np.bincount(ids, gap[words, j] * value, len(seen)) for j in range(k)], 1) - 0.02 * weights
        speed += grad**2
        weights += step * grad / np.sqrt(speed)
        grad = (real - pairs) / max(1, len(truth)) * 100
        move_speed += grad**2
        log_move += step * grad / np.sqrt(move_speed)
        log_move = np.clip(log_move, -6, 6)
    table = np.zeros((BUCKETS, k), np.float32)
    table[seen] = weights
    return Model(labels, table, np.exp(log_move - log_move.max()), begin)


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees; a null id is in no fold, and not learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, languages: int = LANGUAGES) -> Model | None:
    """Fit to about ``rows`` rows of each of the ``languages`` most frequent values of lang, chosen by a hash of the id among texts of at most ``chars`` characters."""
    usable = docs.filter(F.col(id_col).isNotNull() & ~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & (F.length(text_col).between(1, chars)))
    counts = {r[0]: r[1] for r in usable.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(languages).collect()}
    if not counts:
        return None
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1 << 30))
    chosen = F.lit(False)
    for lang, n in sorted(counts.items()):
        chosen = chosen | ((F.col(lang_col) == lang) & (draw < int(min(1.0, rows / n) * (1 << 30))))
    got = sorted((r[0], r[1], r[2]) for r in usable.filter(chosen).select(id_col, lang_col, text_col).collect())
    return fit([t for _, _, t in got], [x for _, x, _ in got])


def _lettered(column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts have a letter. ASCII letters are seen in the bytes; only texts without one are looked at as text."""
    low = data | 32
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum((low >= 97) & (low <= 122), out=total[1:])
    out = total[offsets[1:]] > total[offsets[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in (column[int(i)].as_py() or ""))
    return out


def _decide(model: Model | None, column: pa.Array) -> tuple[list[str], np.ndarray]:
    labels, scores = [], np.zeros(len(column))
    data, offsets = texts_of(column)
    for a, b, part, cut in slices(data, offsets):
        if model is None:
            labels += [UNKNOWN] * (b - a)
            continue
        share = model.score(part, cut)
        best, letters = share.argmax(1), _lettered(column.slice(a, b - a), part, cut)
        scores[a:b] = np.where(letters, np.clip(share.max(1), 0, 1), 0)
        labels += [model.labels[j] if ok else UNKNOWN for j, ok in zip(best, letters, strict=True)]
    return labels, scores


def identify(docs: DataFrame, model: Model | None, *, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "lang_score") -> DataFrame:
    """All columns of docs, with the predicted language and its score (replacing columns of those names)."""
    docs = docs.drop(*(c for c in docs.columns if c.lower() in (pred_col.lower(), score_col.lower())))
    at = [c.lower() for c in docs.columns].index(text_col.lower())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, scores = _decide(shared.value, batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.string()), pa.array(scores)], names=[*batch.schema.names, pred_col, score_col])

    small_batches(docs.sparkSession)
    schema = StructType([*docs.schema.fields]).add(pred_col, "string").add(score_col, "double")
    return docs.mapInArrow(run, schema)
