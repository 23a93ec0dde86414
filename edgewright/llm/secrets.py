"""Secret scan: fixed patterns, and a character network over every candidate.

Candidates are all runs of visible ASCII of 12 characters or more, without
punctuation at their ends. What the fixed patterns find is scored too, never
dropped; the network adds those other candidates that it takes for secrets.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "network")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so shorter ones fail as a whole
DIGIT = re.compile(r"[0-9]")
CANDIDATE = re.compile(r"[!-~]{12,}")
EDGES = "\"'`()[]{}<>,;:.!?|*"
SHORTEST = 12

WIDTH, AROUND = 48, 24
#: Characters the network tells apart: printable ASCII, other, none.
N_CHARS = 97


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns by kind, leftmost and not overlapping within a kind."""
    found = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if DIGIT.search(text) or HEX.search(text):
        found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Runs of visible ASCII of SHORTEST characters or more, apart from base spans."""
    out, rest = [], sorted((a, b) for _, a, b in taken)
    for m in CANDIDATE.finditer(text):
        start, stop = m.span()
        while rest and rest[0][1] <= start:
            rest.pop(0)
        pieces, at = [], start
        for a, b in rest:  # a span that reaches beyond the run stays for the next one
            if a >= stop:
                break
            pieces.append((at, a))
            at = max(at, b)
        for a, b in [*pieces, (at, stop)]:
            run = text[a:b]
            a += len(run) - len(run.lstrip(EDGES))
            b -= len(run) - len(run.rstrip(EDGES))
            if b - a >= SHORTEST:
                out.append((a, b))
    return out


def window(text: str, start: int, end: int) -> str:
    """WIDTH characters from ``start`` (no further than ``end``) with AROUND more on either side, filled up with NUL."""
    left, mid, right = text[max(0, start - AROUND) : start], text[start : min(end, start + WIDTH)], text[min(end, start + WIDTH) : min(end, start + WIDTH) + AROUND]
    return left.rjust(AROUND, "\0") + mid.ljust(WIDTH, "\0") + right.ljust(AROUND, "\0")


def windows_of(text: str, start: int, end: int) -> list[str]:
    """The whole candidate: one window, or several half a WIDTH apart, the last at its end."""
    starts = [*range(start, max(start, end - WIDTH), WIDTH // 2), max(start, end - WIDTH)]
    return [window(text, a, end) for a in starts]


def encode(windows: list[str]) -> np.ndarray:
    """A row of character numbers for each window."""
    codes = np.frombuffer("".join(windows).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64).reshape(len(windows), -1)
    return np.where(codes == 0, 96, np.where((codes >= 32) & (codes < 127), codes - 32, 95))


@dataclass
class Network:
    """Embedding, one convolution over characters, maximum over places, logistic output with Platt's calibration."""

    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5
    KERNEL = 5

    def windows(self, x: np.ndarray) -> np.ndarray:
        e = self.embed[x]
        n = x.shape[1] - self.KERNEL + 1
        return np.concatenate([e[:, i : i + n] for i in range(self.KERNEL)], axis=2)

    def raw(self, x: np.ndarray) -> np.ndarray:
        a = np.maximum(self.windows(x) @ self.conv + self.bias, 0)
        return np.concatenate((a.max(1), a.mean(1)), axis=1) @ self.out + self.out_bias

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.offset, -40, 40)))


def drawn_findings(n: int, seed: int) -> tuple[list[str], list[int]]:
    """Findings with labels, drawn by a fixed seed: keys of many lengths in code-like context against long words, paths, addresses, ids and rules."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))
    syllables = ["an", "er", "tion", "the", "on", "ing", "schaft", "keit", "mente", "ue", "que", "eau", "lo", "ra", "st", "en"]
    word = lambda k: "".join(rng.choice(syllables, k))
    alnum, b64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    xs, ys = [], []
    for _ in range(n):
        before, after = " ".join(word(2) for _ in range(4)), " ".join(word(2) for _ in range(4))
        if rng.random() < 0.5:
            key = [
                lambda: pick(alnum, rng.integers(20, 90)),
                lambda: pick(b64, rng.integers(40, 120)),
                lambda: "ghp_" + pick(alnum, 36),
                lambda: "sk-" + pick(alnum, 32),
                lambda: pick(string.ascii_lowercase + string.digits, rng.integers(20, 64)),
                lambda: "/".join(word(2) for _ in range(rng.integers(2, 9))) + "/" + pick(alnum, rng.integers(24, 44)),
                lambda: pick(alnum + "!@#$%^&*", rng.integers(14, 24)),
            ][rng.integers(7)]()
            lead = ["key=", "auth: ", "Bearer ", '"', "", "credential = "][rng.integers(6)]
            label = 1
        else:
            key = [
                lambda: word(rng.integers(5, 14)),
                lambda: word(6) + pick(string.digits, 2),
                lambda: "/".join(word(2) for _ in range(rng.integers(3, 14))) + "/" + pick(string.digits, 3),
                lambda: f"20{pick(string.digits, 2)}-{pick('01', 2)}-{pick('012', 2)}_" + word(3),
                lambda: "_".join(word(2) for _ in range(4)) + "_v" + pick(string.digits, 1),
                lambda: "-".join([pick(string.digits, 4) for _ in range(4)]) + word(1),
                lambda: "https://www." + word(3) + ".com/" + "/".join(word(2) for _ in range(rng.integers(1, 5))),
                lambda: word(2) + "." + word(2) + "@" + word(3) + ".org",
                lambda: pick("-=_#*|", 1) * int(rng.integers(12, 60)),
                lambda: word(rng.integers(4, 9)).upper() + pick("#$&%", 1) * int(rng.integers(0, 4)),
            ][rng.integers(10)]()
            lead, label = ["", "see ", "(", "/", "id "][rng.integers(5)], 0
        text = f"{before} {lead}{key} {after}"
        at = len(before) + 1 + len(lead)
        found = windows_of(text, at, at + len(key))
        # of a long key the last window is surely key; of other runs any will do
        xs.append(found[-1] if label else found[int(rng.integers(len(found)))])
        ys.append(label)
    return xs, ys


def found_in(docs: DataFrame, rows: int, most: int) -> tuple[list[str], list[int]]:
    """Findings of some ``rows`` documents, drawn by a hash of their doc_id: what the fixed patterns find is 1, other candidates are 0; ``most`` of each at most, by hash."""
    step = max(1, docs.count() // rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = [], []
            for text in batch.column(0).to_pylist():
                base = base_spans(text or "")
                for label, spans in ((1, [(a, b) for _, a, b in base]), (0, candidates(text or "", base))):
                    for a, b in spans:
                        windows = windows_of(text, a, b)
                        xs += windows[-1:] if label else windows
                        ys += [label] * (1 if label else len(windows))
            yield pa.RecordBatch.from_arrays([pa.array([x.encode("utf-8", "replace") for x in xs], pa.binary()), pa.array(ys, pa.int32())], ["window", "label"])

    some = docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(7)), F.lit(step)) == 0).select(F.col("text").cast("string"))
    found = some.mapInArrow(run, "window binary, label int").distinct()
    at = F.xxhash64("window")
    kept = [found.where(F.col("label") == k).orderBy(at, "window").limit(most) for k in (0, 1)]
    got = kept[0].unionByName(kept[1]).collect()
    return [bytes(r["window"]).decode("utf-8", "replace") for r in got], [r["label"] for r in got]


def trained(docs: DataFrame, n_findings: int = 1500, rows: int = 20_000, most: int = 1500, recall: float = 0.95, seed: int = 3) -> "Network":
    """The network of ``n_findings`` drawn findings and of up to ``most`` secrets and ``most`` other candidates from some ``rows`` of ``docs``."""
    rng, parts = np.random.default_rng(seed), ([], [])
    for kind, (xs, ys) in enumerate((drawn_findings(n_findings, seed), found_in(docs, rows, most))):
        x, y = encode(xs) if xs else np.empty((0, WIDTH + 2 * AROUND), np.int64), np.array(ys, float)
        order = rng.permutation(len(x))
        for part, own in zip(parts, (order[len(x) // 3 :], order[: len(x) // 3])):
            # the few secrets of documents weigh as much as the drawn ones
            few = own[y[own] == 1]
            again = np.repeat(few, max(1, n_findings // 2 * len(own) // max(1, len(x)) // max(1, len(few))) - 1) if kind else own[:0]
            part.append((x[np.concatenate((own, again))], y[np.concatenate((own, again))]))
    fit, held = ([np.concatenate(v) for v in zip(*part)] for part in parts)
    return train_network(*fit, *held, recall, seed=seed)


def train_network(x: np.ndarray, y: np.ndarray, held_x: np.ndarray, held_y: np.ndarray, recall: float = 0.95, filters: int = 16, width: int = 8, epochs: int = 12, rate: float = 0.02, seed: int = 3) -> Network:
    """Fit on ``x, y``; on the held findings, calibrate, and take the largest threshold that keeps ``recall`` of the secrets."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.5, (N_CHARS, width)), rng.normal(0, 0.3, (Network.KERNEL * width, filters)), np.zeros(filters), rng.normal(0, 0.3, 2 * filters), 0.0)
    params, first, second, step = ["embed", "conv", "bias", "out"], {}, {}, 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for start in range(0, len(x), 64):
            rows = order[start : start + 64]
            xb, yb = x[rows], y[rows]
            w = net.windows(xb)
            a = np.maximum(w @ net.conv + net.bias, 0)
            top, places = a.max(1), a.argmax(1)
            pooled = np.concatenate((top, a.mean(1)), axis=1)
            g = (1 / (1 + np.exp(-np.clip(pooled @ net.out + net.out_bias, -40, 40))) - yb) / len(rows)
            dp = np.outer(g, net.out)
            da = np.repeat(dp[:, None, filters:] / a.shape[1], a.shape[1], axis=1)
            np.put_along_axis(da, places[:, None, :], np.take_along_axis(da, places[:, None, :], 1) + dp[:, None, :filters], 1)
            da *= a > 0
            dw = da @ net.conv.T
            de = np.zeros_like(net.embed)
            for i in range(Network.KERNEL):
                np.add.at(de, xb[:, i : i + a.shape[1]], dw[:, :, i * width : (i + 1) * width])
            grads = {"embed": de, "conv": np.einsum("nlk,nlf->kf", w, da), "bias": da.sum((0, 1)), "out": pooled.T @ g}
            step += 1
            net.out_bias -= rate * g.sum()
            for name in params:
                first[name] = 0.9 * first.get(name, 0) + 0.1 * grads[name]
                second[name] = 0.999 * second.get(name, 0) + 0.001 * grads[name] ** 2
                setattr(net, name, getattr(net, name) - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8))
    z, t = net.raw(held_x), held_y
    for _ in range(200):  # Platt: slope and offset by gradient
        p = 1 / (1 + np.exp(-np.clip(net.slope * z + net.offset, -40, 40)))
        net.slope -= 0.05 * float(((p - t) * z).mean())
        net.offset -= 0.05 * float((p - t).mean())
    held = np.sort(net.probability(held_x[t == 1]))
    net.threshold = float(held[int((1 - recall) * len(held))])
    return net


def scores(text: str, found: list[tuple[int, int]], net: Network) -> np.ndarray:
    """A probability for each range: the greatest of its windows."""
    if not found:
        return np.empty(0)
    windows = [windows_of(text, a, b) for a, b in found]
    flat, begin = [w for ws in windows for w in ws], np.cumsum([0, *map(len, windows[:-1])])
    p = np.concatenate([net.probability(encode(flat[at : at + 512])) for at in range(0, len(flat), 512)])
    return np.maximum.reduceat(p, begin)


def spans(text: str, net: Network) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and those that the network adds."""
    base = base_spans(text)
    rest = candidates(text, base)
    return base, [("network", a, b) for (a, b), p in zip(rest, scores(text, rest, net)) if p >= net.threshold]


def joined(found: list[tuple[str, int, int]]) -> str:
    ordered = sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered)


def scanned(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_candidates, base_score`` for each row of ``docs``.

    Offsets are code points of the whole text, ends exclusive. Base spans all
    stay; ``base_score`` is the least of the network's probabilities for them
    (null without any), ``n_candidates`` how many other runs it judged. The
    network is ``net``, or else trained on ``docs`` (``trained``). A null text is
    empty: no spans, and the digest of ''. Equal texts give equal spans, ties of
    place go by kind; repeated rows repeat; an empty table gives an empty one.
    """
    net = net or trained(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(1):
                text = x.as_py() or ""
                base = base_spans(text)
                rest = candidates(text, base)
                p = scores(text, [(a, b) for _, a, b in base] + rest, net)
                more = [("network", a, b) for (a, b), q in zip(rest, p[len(base) :]) if q >= net.threshold]
                kinds = [k for k, _, _ in base]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), digest, joined(base + more), len(rest), float(p[: len(base)].min()) if base else None))
            columns = list(zip(*rows)) or [()] * 7
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, types))], names)

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_candidates long, base_score double"
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def redacted(docs: DataFrame, mask: str = "[secret]", net: Network | None = None) -> DataFrame:
    """``doc_id, text`` with every span replaced by ``mask``; overlapping spans become one. Null stays null."""
    net = net or trained(docs)

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for _, a, b in sorted(sum(spans(text, net), []), key=lambda x: x[1:]):
            if b <= at:
                continue
            if a >= at:
                out += [text[at:a], mask]
            at = b
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([clean(x) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, text string")
