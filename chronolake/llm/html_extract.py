"""Main-text extraction with a bidirectional LSTM over a page's blocks, in numpy.

A page is read once into leaf blocks: the text between block-level tags, with the
path of open block elements and their class, id and role words. A block's input
is the sum of its hashed path words' vectors, the mean of its hashed words'
vectors, and four numbers (length, share of linked text, depth, place). The LSTM
reads the blocks in both directions and labels each one. It is fitted on a
bounded sample of the pages themselves: a teacher marks blocks by semantic
elements, and the sample is varied (other content containers, inserted menus,
notices, adverts, forms, comments) so that labels do not hang on one template.
"""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import _text as T

TRAIN_PAGES, EPOCHS, BATCH = 400, 6, 16
PATHS, PATH_DIM, WORDS, WORD_DIM, NUMBERS, HIDDEN = 2048, 16, 1024, 8, 4, 16

# Elements of HTML by kind.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr nobr picture source".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg noframes xmp".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# What the teacher and the variations call content and what not.
CONTENT = ["article", "main", "div class=content", "div class=post", "section class=entry", "div id=content", "div role=main", "div class=article-body"]
OTHER = ["nav", "aside", "footer", "header", "form", "div class=ad", "div class=advert", "div class=sidebar", "div class=menu", "div class=cookie-notice", "div class=notice", "div class=banner", "div class=comments", "section id=comments", "div class=comment", "ul class=breadcrumb", "div class=related", "div class=share", "div class=newsletter", "div role=navigation", "div class=promo", "div class=footer", "div class=header", "div id=sidebar"]
_CONTENT_WORDS = {w for x in CONTENT for w in re.split(r"[ =]", x)} - {"div", "section", "class", "id", "role"}
_OTHER_WORDS = ({w for x in OTHER for w in re.split(r"[ =]", x)} - {"div", "section", "ul", "class", "id", "role"}) | {"ads", "advertisement", "button", "select", "nav", "cookie", "menu", "comment-list"}

# a quote opens a value only after "="; what never closes ends with the page, so no part is read twice
_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
NESTING = {"svg", "math", "template"}  # raw elements that may hold their own kind


def _raw_end(page: str, at: int, tag: str) -> int:
    """Where the raw element whose content starts at ``at`` ends."""
    depth = 1
    for m in re.compile(rf"<(/?){tag}\b[^>]*>", re.I).finditer(page, at):
        if m[1]:
            depth -= 1
        elif tag in NESTING and not m[0].endswith("/>"):
            depth += 1
        if depth == 0:
            return m.end()
    return len(page)


def blocks(page: str) -> list[tuple[str, tuple[str, ...], float]]:
    """(text, path words, share of its characters inside links) of each leaf block that has text."""
    found, stack, parts = [], [], []
    at, linked, size, link = 0, 0, 0, 0

    def flush():
        nonlocal parts, linked, size, link
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            found.append((text, tuple(w for _, words in stack for w in words), linked / max(1, size)))
        parts, linked, size, link = [], 0, 0, 0

    def add(piece):
        nonlocal linked, size
        parts.append(piece)
        size += len(piece)
        if link:
            linked += len(piece)

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in INLINE:
                link -= tag == "a" and link > 0
                continue
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in RAW:
            if not (tag in NESTING and m[3].endswith("/")):
                at = _raw_end(page, at, tag)
            continue
        if tag in INLINE:
            if tag == "br":
                add(" ")
            link += tag == "a"
            continue
        flush()
        if tag in ENDS_P and stack and stack[-1][0] == "p":
            stack.pop()
        if tag in SIBLINGS and stack and stack[-1][0] in SIBLINGS[tag]:
            stack.pop()
        if tag in VOID or m[3].endswith("/") and tag not in ENDS_P:
            continue
        words = [tag]
        for a in _ATTR.finditer(m[3]):
            words += [f"{a[1].lower()}={w.lower()}" for w in (a[2] or a[3] or a[4] or "").split()]
        stack.append((tag, words))
    flush()
    return found


CELLS = 16_384  # padded blocks that are labelled together


def teacher(path: tuple[str, ...]) -> int:
    words = {w.partition("=")[2] or w for w in path}
    inside = bool(words & _CONTENT_WORDS)
    return int(inside and not words & _OTHER_WORDS)


_CODES: dict[str, int] = {}


def _code(word: str) -> int:
    c = _CODES.get(word)
    if c is None:
        if len(_CODES) > 200_000:
            _CODES.clear()
        c = _CODES[word] = zlib.crc32(word.encode()) % PATHS
    return c


def inputs(pages):
    """Flat features of many pages' blocks: path codes and owners, word codes and owners, numbers."""
    path, owner, texts, numbers = [], [], [], []
    i = 0
    for page in pages:
        n = len(page)
        for k, (text, words, linked) in enumerate(page):
            path += map(_code, words)
            owner += [i] * len(words)
            texts.append(text)
            numbers.append((np.log1p(len(text)) / 8, linked, min(len(words), 20) / 10, (k + 1) / n))
            i += 1
    h, first = T.word_hashes(pa.array(texts, pa.large_string()), T.SPACES)
    return (np.array(path, np.int64), np.array(owner, np.int64)), ((h % np.uint64(WORDS)).astype(np.int64), first), np.array(numbers, np.float32).reshape(-1, NUMBERS)


def new_model(seed: int = 3) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    d = PATH_DIM + WORD_DIM + NUMBERS
    m = {"path": r.normal(0, 0.3, (PATHS, PATH_DIM)), "word": r.normal(0, 0.1, (WORDS, WORD_DIM))}
    for k in "fb":
        m[f"w{k}"] = r.normal(0, 1 / np.sqrt(d + HIDDEN), (d + HIDDEN, 4 * HIDDEN))
        m[f"v{k}"] = np.zeros(4 * HIDDEN)
        m[f"v{k}"][HIDDEN : 2 * HIDDEN] = 1
    m["out"], m["bias"] = r.normal(0, 0.3, 2 * HIDDEN), np.zeros(1)
    return {k: x.astype(np.float32) for k, x in m.items()}


def _embed(m, feats):
    (path, owner), (word, first), numbers = feats
    n = len(numbers)
    x = np.zeros((n, PATH_DIM + WORD_DIM + NUMBERS), np.float32)
    for k in range(PATH_DIM):
        x[:, k] = np.bincount(owner, m["path"][path, k], n)
    count = np.diff(first)
    full = count > 0
    if len(word):
        x[full, PATH_DIM : PATH_DIM + WORD_DIM] = np.add.reduceat(m["word"][word], first[:-1][full], axis=0) / count[full, None]
    x[:, PATH_DIM + WORD_DIM :] = numbers
    return x


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(w, v, x, mask, learn=True):
    """x: (steps, pages, d). Hidden states and what the backward pass needs."""
    steps, pages, _ = x.shape
    h, c, keep = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32), []
    out = np.zeros((steps, pages, HIDDEN), np.float32)
    xw = x @ w[: x.shape[2]] + v
    u = w[x.shape[2] :]
    for t in range(steps):
        g = xw[t] + h @ u
        i, f, o = _sigmoid(g[:, :HIDDEN]), _sigmoid(g[:, HIDDEN : 2 * HIDDEN]), _sigmoid(g[:, 2 * HIDDEN : 3 * HIDDEN])
        a = np.tanh(g[:, 3 * HIDDEN :])
        on = mask[t][:, None]
        c2 = np.where(on, f * c + i * a, c)
        tc = np.tanh(c2)
        h2 = np.where(on, o * tc, h)
        if learn:
            keep.append((h, c, i, f, o, a, tc, on))
        h, c = h2, c2
        out[t] = h
    return out, keep


def _lstm_back(w, x, keep, dout):
    steps, pages, d = x.shape
    u = w[d:]
    dg = np.zeros((steps, pages, 4 * HIDDEN), np.float32)
    du = np.zeros_like(u)
    dh, dc = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, a, tc, on = keep[t]
        dh = dh + dout[t]
        step = np.where(on, dh, 0)
        dcell = np.where(on, dc + step * o * (1 - tc * tc), 0)
        g = dg[t]
        g[:, :HIDDEN] = dcell * a * i * (1 - i)
        g[:, HIDDEN : 2 * HIDDEN] = dcell * c * f * (1 - f)
        g[:, 2 * HIDDEN : 3 * HIDDEN] = step * tc * o * (1 - o)
        g[:, 3 * HIDDEN :] = dcell * i * (1 - a * a)
        du += h.T @ g
        dh = np.where(on, g @ u.T, dh)
        dc = np.where(on, dcell * f, dc)
    dw = np.concatenate([np.tensordot(x, dg, ((0, 1), (0, 1))), du])
    return dw, dg.sum(axis=(0, 1)), dg @ w[:d].T


def _grid(x, sizes):
    """(steps, pages, d) both ways round, the mask, and each block's (step, page)."""
    steps, pages = int(sizes.max()), len(sizes)
    page = np.repeat(np.arange(pages), sizes)
    step = np.arange(len(page)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    back = np.repeat(sizes, sizes) - 1 - step
    f = np.zeros((steps, pages, x.shape[1]), np.float32)
    b = np.zeros_like(f)
    f[step, page], b[back, page] = x, x
    mask = np.arange(steps)[:, None] < sizes[None]
    return f, b, mask, step, back, page


def predict(m, pages) -> list[np.ndarray]:
    """Probability of content for each block of each page (a page: its blocks); pages of like length go together, at most CELLS padded blocks or one page."""
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and end - at < 64 and (end + 1 - at) * len(pages[order[end]]) <= CELLS:
            end += 1
        part, at = order[at:end], end
        sizes = np.array([len(pages[i]) for i in part])
        x = _embed(m, inputs([pages[i] for i in part]))
        f, b, mask, step, back, page = _grid(x, sizes)
        hf, _ = _lstm(m["wf"], m["vf"], f, mask, False)
        hb, _ = _lstm(m["wb"], m["vb"], b, mask, False)
        p = _sigmoid(np.concatenate([hf[step, page], hb[back, page]], axis=1) @ m["out"] + m["bias"])
        for i, z in zip(part, np.split(p, np.cumsum(sizes)[:-1])):
            out[i] = z
    return out


def _varied(pages, rng):
    """The pages with other containers and inserted blocks: [(blocks, labels)]."""
    pool = [b for p in pages for b in p]
    done = []
    for p in pages:
        if not p or not pool:
            continue
        new, labels = [], []
        content = tuple(re.split(r" ", CONTENT[rng.integers(len(CONTENT))])) if rng.random() < 0.6 else None
        for text, path, linked in p:
            y = teacher(path)
            if content and "article" in path:
                k = path.index("article")
                path = path[:k] + content + path[k + 1 :]
            new.append((text, path, linked))
            labels.append(y)
        for _ in range(rng.integers(0, 4)):
            box = tuple(OTHER[rng.integers(len(OTHER))].split(" "))
            inner = (box[0] not in ("nav", "header", "footer")) and rng.random() < 0.4
            k = int(rng.integers(0, len(new) + 1))
            base = new[min(k, len(new) - 1)][1] if inner else ("html", "body")
            base = base[:-1] if inner and base and base[-1] in ("p", "h1", "li") else base
            for _ in range(rng.integers(1, 4)):
                text, _, _ = pool[rng.integers(len(pool))]
                tail = (("p",), (), ("ul", "li"), ("h3",), ("input",))[rng.integers(4)]
                new.insert(k, (text, base + box + tail, float(tail == ("ul", "li"))))
                labels.insert(k, 0)
        done.append((new, labels))
    return done


def fit(pages: list[str], seed: int = 3) -> dict[str, np.ndarray]:
    """A model from whole pages, by Adam on the logistic loss."""
    rng = np.random.default_rng(seed)
    read = [b for b in map(blocks, pages) if b]
    m = new_model(seed)
    if not read:
        return m
    mean, var, t = {k: np.zeros_like(x) for k, x in m.items()}, {k: np.zeros_like(x) for k, x in m.items()}, 0
    for _ in range(EPOCHS):
        data = _varied(read, rng)
        data.sort(key=lambda d: len(d[0]))
        starts = np.arange(0, len(data), BATCH)
        for at in rng.permutation(starts):
            part = data[at : at + BATCH]
            sizes = np.array([len(b) for b, _ in part])
            y = np.concatenate([l for _, l in part]).astype(np.float32)
            feats = inputs([b for b, _ in part])
            x = _embed(m, feats)
            f, b, mask, step, back, page = _grid(x, sizes)
            hf, kf = _lstm(m["wf"], m["vf"], f, mask)
            hb, kb = _lstm(m["wb"], m["vb"], b, mask)
            h = np.concatenate([hf[step, page], hb[back, page]], axis=1)
            p = _sigmoid(h @ m["out"] + m["bias"])
            e = (p - y) / len(y)
            g = {"out": h.T @ e, "bias": np.array([e.sum()])}
            dh = e[:, None] * m["out"]
            df, db = np.zeros_like(hf), np.zeros_like(hb)
            df[step, page], db[back, page] = dh[:, :HIDDEN], dh[:, HIDDEN:]
            g["wf"], g["vf"], dxf = _lstm_back(m["wf"], f, kf, df)
            g["wb"], g["vb"], dxb = _lstm_back(m["wb"], b, kb, db)
            dx = dxf[step, page] + dxb[back, page]
            (path, owner), (word, first), _ = feats
            g["path"], g["word"] = np.zeros_like(m["path"]), np.zeros_like(m["word"])
            np.add.at(g["path"], path, dx[owner, :PATH_DIM])
            count = np.diff(first)
            np.add.at(g["word"], word, (dx[:, PATH_DIM : PATH_DIM + WORD_DIM] / np.maximum(count, 1)[:, None])[np.repeat(np.arange(len(count)), count)])
            t += 1
            for k in m:
                mean[k] = 0.9 * mean[k] + 0.1 * g[k]
                var[k] = 0.999 * var[k] + 0.001 * g[k] ** 2
                m[k] = (m[k] - 0.01 * (mean[k] / (1 - 0.9**t)) / (np.sqrt(var[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return m


_SHAPES = {k: x.shape for k, x in new_model().items()}


def _fit(table: pa.Table) -> pa.Table:
    table = table.take(pa.compute.sort_indices(table, [("turn", "ascending"), ("page_id", "ascending")]))
    m = fit(table.column("html").to_pylist())
    return pa.table({"model": pa.array([b"".join(m[k].tobytes() for k in _SHAPES)], pa.binary())})


def _unpack(raw: bytes) -> dict[str, np.ndarray]:
    m, at = {}, 0
    for k, shape in _SHAPES.items():
        n = int(np.prod(shape))
        m[k] = np.frombuffer(raw, np.float32, n, at).reshape(shape)
        at += 4 * n
    return m


def train(pages: DataFrame, rows: int = TRAIN_PAGES) -> dict[str, np.ndarray]:
    """The model, fitted in one task on at most ``rows`` pages (lowest hash of the id first)."""
    ship(pages.sparkSession)
    sample = pages.where("html is not null and html <> ''").select("page_id", "html", F.xxhash64("page_id").alias("turn")).orderBy("turn", "page_id").limit(rows)
    got = sample.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(_fit, "model binary").collect()
    return _unpack(bytes(got[0].model)) if got else new_model()


def _extract(model):
    def f(batches):
        for b in batches:
            texts = []
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                read = [blocks(x) if x else [] for x in part.column("html").to_pylist()]
                for page, p in zip(read, predict(model, read)):
                    texts.append("\n".join(x[0] for x, q in zip(page, p) if q >= 0.5))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return f


def extract(pages: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """page_id, url, text and n_chars of every page: its content blocks in order, joined by a newline.

    Character references are decoded and white space inside a block becomes one
    space. A null or empty page, or one without content blocks, gives "". Repeated
    rows each give a row; extra columns are ignored.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract(model), "page_id long, url string, text string, n_chars long")


def op10_html_extraction(spark, sf_dir) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, train(pages))
