"""Markup residue: naming the blocks of a text that hold it, and turning marked-up text into clean text.

A text becomes a sequence of leaf blocks, each with a path of the constructs that are open around it and the hashed words and
sign shapes in it. A bidirectional LSTM, written and trained in numpy, reads the whole sequence of a document and labels every
block with that context: what kind of block it is, and whether it holds markup residue. The network's label decides. It is
fitted on blocks of a bounded sample of the corpus, which a markup grammar labels by the places of its finds in the whole text,
and on made-up blocks that mix clean words with broken markup and with ordinary signs that only look like it. The
grammar has no other use.

Defined cases
    Null, empty and blank texts hold no residue and give no clean text. Whole texts of any length are read; long lines are
    several blocks, and a construct that reaches over several blocks makes all of them residue. Repeated rows of a key count once. An empty table gives no rows; the network is then trained on made-up
    blocks only. Only the key and text columns are read.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusmill.functions import wikitext
from corpusmill.runtime import ship

KINDS = ("prose", "heading", "list", "code", "formula", "table", "template", "quote")
#: Hash buckets of words and shapes, sizes of their vectors and of the states.
BUCKETS, WIDTH, STATE = 16384, 16, 16
#: Texts of the fitting sample at most: any texts, and texts with signs that markup consists of.
SAMPLE, SIGNS = 1000, 3000
#: The probability from which a block is residue, and the lower one from which p3_clean rewrites a block.
RESIDUE, REWRITE = 0.5, 0.01
#: Words of a block at which it ends with the next sentence, and letters after which a line without sentences is cut at a space.
BLOCK_WORDS, BLOCK_LETTERS = 32, 600

# What is markup of wikis, HTML, Markdown and LaTeX, broken or whole.
_entity = r"&(?:[A-Za-z][A-Za-z0-9]+|#\d+|#[xX][0-9A-Fa-f]+);"
_tags = "a abbr b big blockquote blink body br caption center cite code col dd del div dl dt em font gallery h1 h2 h3 h4 h5 h6 head hr html i iframe img includeonly input ins kbd li link mark math meta noinclude nowiki ol onlyinclude p pre poem q ref references s samp script section small source span strike strong style sub sup svg syntaxhighlight table tbody td tfoot th thead tr tt u ul var video".split()
MARKUP = [
    r"\[\[", r"\]\]", r"\{\{", r"\}\}", r"\{\|", r"(?m:^\s*\|[}-])", r"(?m:^\s*!\s.*!!)", r"\|\|", r"'''?", r"__[^\s_](?:[^_\n]*[^\s_])?__", r"~~~+", r"~~[^\s~](?:[^~\n]*[^\s~])?~~",
    r"(?m:(?:^|(?<=\s))(={2,6})\s*\S[^\n=]*\S?\s*\1(?=\s|$))", r"(?m:^\s*\|\s*\w[\w -]*=)", r"(?<=\s)\|\w[\w -]*=(?=\s?\S)", r"(?i:#REDIRECT\b)", r"\|thumb\||\|\d+px\b", r"\[(?:https?:)?//\S+",
    r"<!--", r"-->", r"<!DOCTYPE\b", rf"(?i:</?(?:{'|'.join(_tags)})(?=[\s/>]|$)[^<>]*>?)", _entity,
    r"\*\*[^\s*](?:[^*\n]*[^\s*])?\*\*", r"\*\*\*+(?=\S)", r"(?m:^\s{0,3}#{1,6}\s+\S)", r"(?m:^\s{0,3}(?:```|~~~))", r"`[^`\n]+`", r"```", r"!\[[^\]\n]*\]\([^)\n]*\)?", r"\[[^\]\n]+\]\((?:https?://|/|#|\.)[^)\s]*\)?", r"\[\^[^\]\s]+\]", r"(?m:^\s*\|?(?:\s*:?-{3,}:?\s*\|)+)", r"(?m:^\s*\|(?:[^|\n]+\|){2,}\s*$)", r"(?m:^\s{0,3}>\s)",
    r"(?<![\w:\\])\\(?:begin|end|section|subsection|chapter|emph|textbf|textit|texttt|underline|cite[pt]?|ref|label|footnote|href|url|item|frac|sqrt|sum|int|mathbf|mathrm|left|right|caption|includegraphics|par|newline|noindent|hline|centering|ldots|dots)\b\*?", r"\\[A-Za-z]+\*?\{", r"\\[(\[].*?\\[)\]]", r"(?<![\w:\\])\\\((?=\S)", r"\$\$", r"\$\\[A-Za-z]+[^$\n]*\$?", r"\$[^\s$\d][^$\n]*[_^{}\\][^$\n]*\$",
]
_markup = re.compile("|".join(MARKUP))
_shape = re.compile(r"[^\W\d_]+|\d+|_+|([^\w\s])\1*")
_sentence = re.compile(r"(?<=[.!?。])[ \t]+(?=\S)")


def markup_in(text: str) -> str | None:
    """The first piece of markup that the grammar finds."""
    m = _markup.search(text)
    return m.group() if m else None


def bucket(feature: str) -> int:
    """The bucket of a feature; words and signs have halves of their own, so that no word weakens a sign."""
    h = zlib.crc32(feature.encode("utf-8", "surrogatepass")) % (BUCKETS // 2)
    return h + BUCKETS // 2 if feature[:1].isalpha() else h


class _Buckets(dict):
    """Buckets of features by word, or by tuples of what stands around a sign."""

    def __missing__(self, key) -> int:
        if len(self) > 300_000:
            self.clear()
        self[key] = h = bucket(key if isinstance(key, str) else ":" + "\t".join(key))
        return h


_buckets = _Buckets()
_names = frozenset(("\\", "&", "<", "/", "{{", "[[", "|"))
_pairs = (("{|", "|}", "table"), ("{{", "}}", "template"))
_opening = re.compile(r"<(/?)(syntaxhighlight|pre|source|math|poem|ref|code)\b[^>]*?(/?)>")


def leaf_lines(text: str) -> list[tuple[int, str, str, int]]:
    """(line, path, block, start) of the lines of a text, long ones in several blocks; the path names what is open around a line.

    A path holds each kind of construct that is open once, in the order of opening, however deep the constructs are nested.
    """
    out: list[tuple[int, str, str, int]] = []
    open_: dict[str, int] = {}
    at = 0
    for no, line in enumerate(text.split("\n")):
        begin, at = at, at + len(line) + 1
        if not line.strip():
            continue
        path = ">".join(open_)
        if len(line) <= 160:
            out.append((no, path, line, begin))
        else:
            a = words = 0
            ends = [m.end() for m in _sentence.finditer(line)] + [len(line)]
            for k, e in enumerate(ends):
                while e - a > BLOCK_LETTERS:  # no sentence end in sight: cut at a space
                    b = line.rfind(" ", a + BLOCK_LETTERS // 3, a + BLOCK_LETTERS) + 1 or a + BLOCK_LETTERS
                    out.append((no, path, line[a:b], begin + a))
                    a, words = b, 0
                words += line.count(" ", ends[k - 1] if k else 0, e)
                if words >= BLOCK_WORDS or e == len(line):
                    if line[a:e].strip():
                        out.append((no, path, line[a:e], begin + a))
                    a, words = e, 0

        def count(name: str, n: int) -> None:
            if (n := open_.get(name, 0) + n) > 0:
                open_[name] = n
            else:
                open_.pop(name, None)

        for mark, end, name in _pairs:
            if mark in line or end in line:
                count(name, line.count(mark) - line.count(end))
        for mark, name in (("```", "fence"), ("$$", "formula")):
            if line.count(mark) % 2:
                count(name, -1 if name in open_ else 1)
        if "<" in line:
            for m in _opening.finditer(line):
                if not m.group(3):
                    count(m.group(2), -1 if m.group(1) else 1)
    return out


def leaf_blocks(text: str) -> list[tuple[str, str]]:
    return [(path, block) for _, path, block, _ in leaf_lines(text)]


def block_residue(text: str, lines: list[tuple[int, str, str, int]]) -> list[float]:
    """1 for the blocks that a find of the grammar in the whole text reaches into, otherwise 0."""
    starts = [start for *_, start in lines]
    out = [0.0] * len(lines)
    for m in _markup.finditer(text):
        for k in range(max(0, bisect_right(starts, m.start()) - 1), bisect_left(starts, max(m.end(), m.start() + 1))):
            if text[max(m.start(), starts[k]) : min(m.end(), starts[k] + len(lines[k][2]))].strip():
                out[k] = 1.0
    return out


def block_features(path: str, block: str) -> np.ndarray:
    """Buckets of the tag path, the words and the shapes of signs; signs count alone, with what touches them before, and with both sides."""
    begin = block.lstrip()[:2]
    feats = [_buckets[">", path], _buckets["^", begin if not begin[:1].isalnum() else "w"]]
    add = feats.append
    before, end = "^", -1
    held: tuple[str, str] | None = None  # a sign whose right side is still to come
    left = ""  # the sign that touches the last word or number on its left
    for m in _shape.finditer(block):
        p = m.group()
        c = p[0]
        touches = m.start() == end
        if c.isalpha():
            now, low = "w", p.lower()
            add(_buckets[low])
            if held and touches and held[1] in _names:  # the word of a command, an entity, a tag, a template or a link
                add(_buckets[held[1], low])
        elif c.isdigit():
            now = "9"
        else:
            now = p if len(p) < 3 else c * 3 + "+"
        if held:
            add(_buckets[held[0], held[1], "" if touches else " ", now])
        if now == "w" or now == "9":
            left = held[1] if held and touches else ""
            held = None
        else:
            add(_buckets[now])
            touch = before if touches else before + " "
            add(_buckets[touch, now])
            if touches and left and (before == "w" or before == "9"):
                add(_buckets[left, before, now, ""])
            held = (touch, now)
        before, end = now, m.end()
    if held:
        add(_buckets[held[0], held[1], "$"])
    return np.array(feats, "int64")


def kind_of(path: str, block: str) -> int:
    """The kind of a block by rule, the label that the network learns and then gives with context."""
    s = block.strip()
    if re.search(r"syntaxhighlight|pre|source|fence|code", path) or re.match(r"(```|<(syntaxhighlight|pre|source|code)\b)", s):
        return 3
    if "math" in path or "formula" in path or re.match(r"(<math\b|\$\$|\\\[|\\begin\{(equation|align))", s):
        return 4
    if "table" in path or s.startswith(("{|", "|}")):
        return 5
    if "template" in path or (s.startswith("{{") and not s.lower().startswith("{{quote")):
        return 6
    if re.fullmatch(r"(={1,6})\s*[^=].*?\1", s) or re.match(r"#{1,6}\s+\S", s):
        return 1
    if re.match(r"([*#;:]+\s*\S|[-+]\s+\S|\d+[.)]\s+\S)", s):
        return 2
    if s.startswith(("> ", "— ")) or s.lower().startswith("{{quote"):
        return 7
    return 0


class BlockLabeller:
    """A bidirectional LSTM over sequences of blocks with a layer that gives each block's kind and its residue probability."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        d, h, out = WIDTH, STATE, len(KINDS) + 1
        init = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype("float32")
        self.p = {"E": rng.normal(0, 0.3, (BUCKETS, d)).astype("float32"), "Wf": init(d + h, 4 * h), "bf": np.zeros(4 * h, "float32"), "Wb": init(d + h, 4 * h), "bb": np.zeros(4 * h, "float32"), "Wo": init(2 * h + 2 * d, out), "bo": np.zeros(out, "float32")}
        for b in ("bf", "bb"):
            self.p[b][h : 2 * h] = 1.0  # remember at first

    @staticmethod
    def _sig(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def _lstm(self, x: np.ndarray, mask: np.ndarray, w: np.ndarray, b: np.ndarray, keep: bool):
        steps, n, h = x.shape[0], x.shape[1], STATE
        hs, cs, gates = np.zeros((steps + 1, n, h), "float32"), np.zeros((steps + 1, n, h), "float32"), []
        for t in range(steps):
            z = np.concatenate([x[t], hs[t]], 1) @ w + b
            i, f, o, g = self._sig(z[:, :h]), self._sig(z[:, h : 2 * h]), self._sig(z[:, 2 * h : 3 * h]), np.tanh(z[:, 3 * h :])
            c = f * cs[t] + i * g
            m = mask[t][:, None]
            cs[t + 1] = m * c + (1 - m) * cs[t]
            hs[t + 1] = m * (o * np.tanh(c)) + (1 - m) * hs[t]
            if keep:
                gates.append((i, f, o, g, c))
        return hs, cs, gates

    def _embed(self, docs: list[list[np.ndarray]], swap: np.random.Generator | None = None):
        steps = max(map(len, docs))
        x = np.zeros((steps, len(docs), 2 * WIDTH), "float32")
        mask = np.zeros((steps, len(docs)), "float32")
        flat = [(t, k, f) for k, doc in enumerate(docs) for t, f in enumerate(doc)]
        idx = np.concatenate([f for _, _, f in flat])
        if swap is not None:  # in fitting, two thirds of the words are replaced by any words, so that names can't tell anything
            other = (idx >= BUCKETS // 2) & (swap.random(len(idx)) < 0.67)
            idx = np.where(other, swap.integers(BUCKETS // 2, BUCKETS, len(idx)), idx)
        sizes = np.array([len(f) for _, _, f in flat])
        starts = np.cumsum(sizes) - sizes
        e = self.p["E"][idx]
        t, k = np.array([a for a, _, _ in flat]), np.array([b for _, b, _ in flat])
        x[t, k, :WIDTH] = np.add.reduceat(e, starts) / np.sqrt(sizes)[:, None]
        x[t, k, WIDTH:] = np.maximum.reduceat(e, starts)
        mask[t, k] = 1
        return x, mask, (idx, sizes, starts, e, t, k)

    def forward(self, docs: list[list[np.ndarray]], keep: bool = False, swap: np.random.Generator | None = None):
        x, mask, how = self._embed(docs, swap)
        hf, cf, gf = self._lstm(x[..., :WIDTH], mask, self.p["Wf"], self.p["bf"], keep)
        hb, cb, gb = self._lstm(x[::-1, :, :WIDTH], mask[::-1], self.p["Wb"], self.p["bb"], keep)
        u = np.concatenate([hf[1:], hb[1:][::-1], x], 2)
        z = u @ self.p["Wo"] + self.p["bo"]
        return z, mask, (x, how, hf, cf, gf, hb, cb, gb, u)

    def train_step(self, docs, kinds, residue, state: dict, rate: float, swap: np.random.Generator | None = None) -> float:
        z, mask, (x, how, hf, cf, gf, hb, cb, gb, u) = self.forward(docs, True, swap)
        steps, n, _ = z.shape
        y, r = np.zeros((steps, n), int), np.zeros((steps, n), "float32")
        for k in range(n):
            y[: len(kinds[k]), k], r[: len(residue[k]), k] = kinds[k], residue[k]
        logits = z[..., :-1] - z[..., :-1].max(2, keepdims=True)
        soft = np.exp(logits) / np.exp(logits).sum(2, keepdims=True)
        sure = self._sig(z[..., -1])
        total = mask.sum()
        loss = -(mask * np.log(np.take_along_axis(soft, y[..., None], 2)[..., 0] + 1e-9)).sum() / total - (mask * (r * np.log(sure + 1e-9) + (1 - r) * np.log(1 - sure + 1e-9))).sum() / total
        dz = np.zeros_like(z)
        dz[..., :-1] = soft
        np.put_along_axis(dz, y[..., None], np.take_along_axis(dz, y[..., None], 2) - 1, 2)
        dz[..., -1] = (sure - r) * np.where(r > 0, 2, 1)  # a missed block costs more than a wrongly named one
        dz *= mask[..., None] / total
        g = {"Wo": np.einsum("tni,tnj->ij", u, dz), "bo": dz.sum((0, 1))}
        du = dz @ self.p["Wo"].T
        h = STATE
        dxf = self._back(x[..., :WIDTH], mask, hf, cf, gf, du[..., :h], "f", g)
        dxb = self._back(x[::-1, :, :WIDTH], mask[::-1], hb, cb, gb, du[::-1, :, h : 2 * h], "b", g)[::-1]
        dx = du[..., 2 * h :].copy()
        dx[..., :WIDTH] += dxf + dxb
        idx, sizes, starts, e, t, k = how
        ge = np.repeat(dx[t, k, :WIDTH] / np.sqrt(sizes)[:, None], sizes, 0)
        top = np.repeat(x[t, k, WIDTH:], sizes, 0)
        ge += np.where(e == top, np.repeat(dx[t, k, WIDTH:], sizes, 0), 0)
        g["E"] = np.zeros_like(self.p["E"])
        order = np.argsort(idx, kind="stable")
        first = np.flatnonzero(np.diff(idx[order], prepend=-1))
        g["E"][idx[order][first]] = np.add.reduceat(ge[order], first)
        state["n"] = state.get("n", 0) + 1
        for name, grad in g.items():
            m, v = state.setdefault(name, (np.zeros_like(grad), np.zeros_like(grad)))
            m[:] = 0.9 * m + 0.1 * grad
            v[:] = 0.99 * v + 0.01 * grad * grad
            self.p[name] -= (rate * (m / (1 - 0.9 ** state["n"])) / (np.sqrt(v / (1 - 0.99 ** state["n"])) + 1e-8)).astype("float32")
        self.p["E"][BUCKETS // 2 :] *= 0.99  # what words tell fades unless it is told again
        return float(loss)

    def _back(self, x, mask, hs, cs, gates, dh_out, which: str, g: dict) -> np.ndarray:
        w, h = self.p["W" + which], STATE
        gw, gb = np.zeros_like(w), np.zeros(4 * h, "float32")
        dx, dh, dc = np.zeros_like(x), np.zeros_like(hs[0]), np.zeros_like(hs[0])
        for t in range(len(x) - 1, -1, -1):
            i, f, o, gg, c = gates[t]
            m = mask[t][:, None]
            dh_t = dh + dh_out[t]
            th = np.tanh(c)
            dct = m * (dc + dh_t * o * (1 - th * th))
            dz = np.concatenate([dct * gg * i * (1 - i), dct * cs[t] * f * (1 - f), m * dh_t * th * o * (1 - o), dct * i * (1 - gg * gg)], 1)
            inp = np.concatenate([x[t], hs[t]], 1)
            gw += inp.T @ dz
            gb += dz.sum(0)
            back = dz @ w.T
            dx[t] = back[:, : x.shape[2]]
            dh = back[:, x.shape[2] :] + (1 - m) * dh_t
            dc = dct * f + (1 - m) * dc
        g["W" + which], g["b" + which] = gw, gb
        return dx

    def label(self, docs: list[list[np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each document the kinds of its blocks and their residue probabilities; documents of similar length run together."""
        out: list = [None] * len(docs)
        order = sorted((k for k in range(len(docs)) if docs[k]), key=lambda k: len(docs[k]))
        at = 0
        while at < len(order):
            n = max(1, min(256, 8192 // max(1, len(docs[order[min(at + 64, len(order) - 1)]]))))
            group = order[at : at + n]
            z, _, _ = self.forward([docs[k] for k in group])
            for c, k in enumerate(group):
                zz = z[: len(docs[k]), c]
                out[k] = (zz[:, :-1].argmax(1), self._sig(zz[:, -1]))
            at += n
        return [o if o is not None else (np.empty(0, int), np.empty(0)) for o in out]


def made_up(rng: random.Random, words: list[str], n: int) -> list[str]:
    """Texts that mix words with markup, whole and broken, and with ordinary signs that look like it."""
    w = lambda: rng.choice(words)
    marks = [
        lambda: f"[[{w()}|{w()}]]", lambda: f"[[{w()}", lambda: f"{w()}]]", lambda: f"[[Category:{w()}]]", lambda: f"[[File:{w()}.png|thumb|12px|{w()}]]", lambda: "{{cn}}", lambda: f"{{{{{w()}|{w()}}}}}", lambda: f"{{{{quote|{w()}", lambda: f"{w()}}}}}", lambda: f"{{{{{{{w()}|}}}}}}", lambda: "{{-}}",
        lambda: f"'''{w()}'''", lambda: f"''{w()} {w()}''", lambda: f"'''{w()}", lambda: f"**{w()} {w()}**", lambda: f"***{w()}***", lambda: f"__{w()}__", lambda: "__NOTOC__", lambda: f"~~{w()}~~", lambda: "~~~~~", lambda: f"`{w()}_12`", lambda: f"\n```\n{w()} = 3\n```\n", lambda: f"\n### {w()}\n", lambda: f"\n== {w()} ==\n", lambda: f"\n=== {w()} ===\n", lambda: f"[{w()}]({w()}.html)", lambda: f"[{w()}](#{w()})", lambda: f"[{w()} {w()}](/{w()}/{w()})", lambda: f"[^{rng.randint(1, 99)}]",
        lambda: f"[{w()}](https://{w()}.example/3)", lambda: f"![{w()}]({w()}.png)", lambda: f"[https://{w()}.example/x {w()} {w()}]", lambda: f"#REDIRECT [[{w()}]]", lambda: f"|{w()} = {rng.randint(1, 99)}", lambda: f"\n|{w()} = {w()}\n|{w()} = 4\n", lambda: f'\n{{| class="wikitable"\n|-\n! {w()} !! {w()}\n|-\n| 3 || {w()}\n|}}\n', lambda: f"\n| {w()} | {w()} |\n|---|---|\n| 3 | {w()} |\n", lambda: f"\n> **{w()}** {w()}",
        lambda: f"<ref>{w()}, leaf 3</ref>", lambda: f'<ref name="{w()}3" />', lambda: "</ref>", lambda: "<br/>", lambda: "<BR>", lambda: f"<b>{w()}</b>", lambda: f"<u>{w()}", lambda: f'<div class="note">{w()}</div>', lambda: '<span style="font-si', lambda: f"<nowiki>{w()}</nowiki>", lambda: f"<poem>{w()}</poem>", lambda: f"<td align=right>{rng.randint(1, 99)}</td>", lambda: f"<!-- {w()} {w()}: check -->", lambda: f"<!-- {w()}", lambda: "</div>",
        lambda: "&nbsp;", lambda: "&#8220;", lambda: "&mdash;", lambda: "&amp;", lambda: "&lt;i&gt;", lambda: "&#x27;", lambda: f"\\emph{{{w()}}}", lambda: f"\\section*{{{w()}}}", lambda: f"\\textbf{{{w()}}}", lambda: f"\\cite{{{w()}3}}", lambda: f"\\footnote{{{w()}}}", lambda: f"\\href{{https://{w()}.example/3}}{{{w()}}}", lambda: f"\\item {w()}", lambda: "\\end{itemize}", lambda: f"\\begin{{itemize}} \\item {w()}", lambda: "\\(x_{3}^2\\)", lambda: "$$a^{2} + b_{1}$$", lambda: "$\\frac{3}{7}$",
        lambda: f"|thumb|286px|{w()}]]", lambda: f"\n## {w().title()} {rng.randint(1, 999)}\n", lambda: f"\n# {w().title()}\n", lambda: f"\\textbf{{{w().title()}}}", lambda: f"\n\\item {w()} {w()}\n", lambda: f"\n~~~~~ {w()}", lambda: f"\n> {w()} {w()}\n", lambda: f"\n*** {w()}", lambda: f"&#{rng.randint(100, 9999)};", lambda: f"</{rng.choice(_tags)}>", lambda: f"<{rng.choice(_tags)}>", lambda: f"<{rng.choice(_tags)} class={w()}>",
    ]
    signs = [
        lambda: "[sic]", lambda: "[...]", lambda: f"[{rng.randint(1, 99)}]", lambda: "{unclear}", lambda: f"{w()} | {w()}", lambda: "2 + 3 = 5", lambda: "5 * 3 * 2", lambda: "3 < 7 > 2", lambda: "<3", lambda: f"9 -> {rng.randint(1, 99)}", lambda: f"C:\\{w()}\\{w()}", lambda: f"a/b/{w()}", lambda: f"*{w()}, roughly", lambda: f"{w()}_7_old", lambda: "~ 5 leagues", lambda: f"#{rng.randint(1, 99)}",
        lambda: "8%", lambda: "$4 or $6", lambda: f"{w()} & Sons", lambda: f"({w()}; {rng.randint(1, 99)})", lambda: f"{w()}; {w()}", lambda: f"{w()}: {w()}", lambda: f"{w()}@{w()}.example", lambda: "'tis", lambda: f"so-called '{w()}'", lambda: "x^2", lambda: f"--{w()}--", lambda: f"\n- {w()} {w()}\n", lambda: f"\n2. {w()}\n", lambda: f"— {w()}", lambda: f"“{w()}”", lambda: f"{w()}'s", lambda: f"({w()})",
    ]
    out = []
    for _ in range(n):
        parts = [w() for _ in range(rng.randint(8, 90))]
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            parts.insert(rng.randint(0, len(parts)), rng.choice(marks)())
        for _ in range(rng.choice([0, 1, 2])):
            parts.insert(rng.randint(0, len(parts)), rng.choice(signs)())
        text = " ".join(p + ("." if rng.random() < 0.08 and p.isalpha() else "") for p in parts)
        out.append(text)
    return out


def train(texts: list[str], rounds: int = 10, seed: int = 7, made: int = 5000) -> BlockLabeller:
    """Fit the network on labelled blocks of the given texts and of `made` made-up ones."""
    rng = random.Random(seed)
    usual = sorted({w for t in texts for w in re.findall(r"[a-z]{3,}", t)})[:3000] or ["river", "stone", "bell", "mill", "reed"]
    data = []
    for text in [*texts, *made_up(rng, usual, made)]:
        if lines := leaf_lines(text):
            features, kinds, residue = [block_features(p, b) for _, p, b, _ in lines], [kind_of(p, b) for _, p, b, _ in lines], block_residue(text, lines)
            # a fitting text is read in parts of 200 blocks, so that one long text doesn't fill a batch
            data += [(features[k : k + 200], kinds[k : k + 200], residue[k : k + 200]) for k in range(0, len(lines), 200)]
    net, state, swap = BlockLabeller(seed), {}, np.random.default_rng(seed)
    for r in range(rounds):
        rng.shuffle(data)
        data.sort(key=lambda d: len(d[0]) // 4)
        batches = [data[k : k + 48] for k in range(0, len(data), 48)]
        rng.shuffle(batches)
        for b in batches:
            net.train_step([d[0] for d in b], [d[1] for d in b], [d[2] for d in b], state, 0.02 / (1 + r), swap)
    return net


def sample_texts(df: DataFrame, keys: list[str], text: str, size: int) -> list[str]:
    """At most `size` texts: those of the lowest hashes of key and text. The share of hashes that can be among them is cut off first."""
    rows = df.where(F.col(text).isNotNull()).select(F.xxhash64(*keys, text).alias("h"), F.col(text).alias("t"))
    share = int(min(1.0, 1.5 * size / max(rows.count(), 1) + 1e-4) * (1 << 20)) - (1 << 19)
    return [r[0] for r in rows.where(F.shiftright("h", 44) <= share).orderBy("h", "t").limit(size).select("t").collect()]


def fit(df: DataFrame, keys: list[str], text: str, sample: int = SAMPLE, signs: int = SIGNS) -> BlockLabeller:
    """The network for a table, fitted on at most `sample` of its texts and `signs` of those that hold signs as markup does."""
    special = df.where(F.col(text).rlike(r"[\[\]{}<>&*~`|$\\\\=]|#\\S|__|''|\\n\\s*[#>!*]"))
    return train(sorted({*sample_texts(df, keys, text, sample), *sample_texts(special, keys, text, signs)}))


def save(net: BlockLabeller, path: str) -> None:
    np.savez(path, **net.p)


def load(path: str) -> BlockLabeller:
    net = BlockLabeller.__new__(BlockLabeller)
    with np.load(path) as held:
        net.p = {k: held[k] for k in held.files}
    return net


def _restore(parameters) -> BlockLabeller:
    net = BlockLabeller.__new__(BlockLabeller)
    net.p = parameters.value
    return net


def residue_blocks(df: DataFrame, key: str, text: str, net: BlockLabeller | None = None, residue: float = RESIDUE) -> DataFrame:
    """Rows (key, blocks, residue_blocks, probability) of the texts in which the network labels a block as residue.

    A network that is given is used; without one, one is fitted on the table first.
    """
    ship(df.sparkSession)
    parameters = df.sparkSession.sparkContext.broadcast((net or fit(df, [key], text)).p)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = _restore(parameters)
        for batch in batches:
            blocks = [leaf_blocks(t) for t in batch.column(1).to_pylist()]
            labels = net.label([[block_features(p, b) for p, b in bs] for bs in blocks])
            found = [k for k, (_, p) in enumerate(labels) if len(p) and p.max() >= residue]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(found, pa.int64())), pa.array([len(blocks[k]) for k in found], pa.int32()),
                pa.array([int((labels[k][1] >= residue).sum()) for k in found], pa.int32()), pa.array([float(labels[k][1].max()) for k in found], pa.float64()),
            ], [key, "blocks", "residue_blocks", "probability"])

    return df.where(F.col(text).isNotNull()).select(key, text).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, blocks int, residue_blocks int, probability double")


_clean_rules: list[tuple[re.Pattern, str]] = [
    (re.compile(r"!\[([^\]\n]*)\]\([^)\n]*\)?"), r"\1"), (re.compile(r"\[([^\]\n]+)\]\((?:https?://|/|#|\.)[^)\s]*\)?"), r"\1"), (re.compile(r"\[\^[^\]\s]+\]"), ""), (re.compile(r"\[(?:https?:)?//\S+\s+([^\]\n]*)\]"), r"\1"), (re.compile(r"\[(?:https?:)?//\S+\]?"), ""),
    (re.compile(r"\*\*\*?([^\s*](?:[^*\n]*[^\s*])?)\*\*\*?"), r"\1"), (re.compile(r"__([^\s_](?:[^_\n]*[^\s_])?)__"), lambda m: "" if m.group(1).isupper() else m.group(1)), (re.compile(r"~~([^\s~](?:[^~\n]*[^\s~])?)~~"), r"\1"), (re.compile(r"~~~+"), ""), (re.compile(r"`([^`\n]+)`"), r"\1"),
    (re.compile(r"\\(?:emph|textbf|textit|texttt|underline)\{([^{}]*)\}"), r"\1"), (re.compile(r"\\(?:cite[pt]?|ref|label|footnote)\{[^{}]*\}"), ""), (re.compile(r"\\href\{[^{}]*\}\{([^{}]*)\}"), r"\1"), (re.compile(r"\\(?:begin|end)\{[^{}]*\}"), ""), (re.compile(r"\\(?:sub)*section\*?\{([^{}]*)\}"), r"\n# \1\n"), (re.compile(r"\\item\b"), "\n- "),
    (re.compile(r"<!--.*?(?:-->|\Z)", re.S), ""), (re.compile(r"-->"), ""), (re.compile(rf"(?i)</?(?:{'|'.join(_tags)})(?=[\s/>]|$)[^<>\n]*>?"), ""), (re.compile(r"'''?"), ""), (re.compile(r"(?i)#REDIRECT\b"), ""), (re.compile(r"\[\[(?:[^|\[\]\n]*\|)*([^|\[\]\n]*)\]\]"), r"\1"), (re.compile(r"\[\[|\]\]"), ""), (re.compile(r"\{\{\{?[^{}\n]*\}\}\}?"), ""), (re.compile(r"\{\{[^{}\n|]*\|?|\}\}+"), ""), (re.compile(r"(?:^|(?<=\s))\|(?:thumb|\d+px)\|?"), ""),
]


def clean_inline(text: str) -> str:
    """A block without inline markup; formulas keep their source."""
    for pattern, to in _clean_rules:
        text = pattern.sub(to, text)
    text = html.unescape(text)
    return re.sub(r"[ \t]+", " ", text).strip()


def resolve_constructs(text: str) -> tuple[str, list[str]]:
    """A text whose constructs of several lines are resolved, and the code blocks taken out of it, which stand as numbered marks.

    Code keeps its lines in a fence, formulas their source between $$, table rows become lines of cells and quote templates
    lines with their speaker; other templates, comments, references, files and categories go.
    """
    text = re.sub(r"<!--.*?-->", "", text, flags=re.S)
    text = re.sub(r"<ref\b[^>]*?/>|<ref\b[^>]*>.*?</ref\s*>", "", text, flags=re.S | re.I)
    kept: list[str] = []

    def keep(body: str) -> str:
        kept.append(body)
        return f"\n\x02{len(kept) - 1}\x03\n"

    text = re.sub(r"<(syntaxhighlight|source|pre)\b[^>]*>(.*?)</\1\s*>", lambda m: keep("```\n" + m.group(2).strip("\n") + "\n```"), text, flags=re.S | re.I)
    text = re.sub(r"```[^\n]*\n(.*?)\n\s*```", lambda m: keep("```\n" + m.group(1) + "\n```"), text, flags=re.S)
    text = re.sub(r"<math\b[^>]*>(.*?)</math\s*>", lambda m: f" $${m.group(1).strip()}$$ ", text, flags=re.S | re.I)
    quoted = []
    last = 0
    for s in wikitext.spans(text):
        if s.depth or s.start < last:
            continue
        body = text[s.start : s.end]
        if s.kind == "template":
            t = wikitext.template_at(text, s)
            quoted.append(text[last : s.start])
            if wikitext.normal_name(t.name) == "quote":
                by = wikitext.plain(t.get("2", "author", "attribution", "speaker"))
                quoted.append("\n" + wikitext.plain(t.get("1", "quote", "text")) + (f"\n— {by}" if by else "") + "\n")
            last = s.end
        elif s.kind == "table":
            quoted.append(text[last : s.start])
            quoted.append("\n" + "\n".join(clean_inline(r) for r in wikitext.table_rows(body)) + "\n")
            last = s.end
        elif s.kind == "link" and re.match(r"\[\[\s*(?:category|file|image)\s*:", body, re.I):
            quoted.append(text[last : s.start])
            last = s.end
    text = "".join(quoted) + text[last:]
    return text, kept


def assemble(lines: list[tuple[int, str, str, int]], kinds: np.ndarray, doubt: np.ndarray, kept: list[str], rewrite: float = REWRITE) -> str:
    """Clean text from labelled blocks: headings become "# " lines and list items "- " lines; only blocks of some residue probability are rewritten."""
    out: list[str] = []
    last = -1
    for (no, _, block, _), kind, p in zip(lines, kinds.tolist(), doubt.tolist()):
        s = block.strip()
        if m := re.fullmatch(r"\x02(\d+)\x03", s):
            body = kept[int(m.group(1))]
        elif m := re.fullmatch(r"(={1,6})\s*(.*?)\s*\1", s):
            body = "#" * len(m.group(1)) + " " + clean_inline(m.group(2))
        elif kind == 1 and (m := re.match(r"(#{1,6})\s+(.*)", s)):
            body = m.group(1) + " " + clean_inline(m.group(2))
        elif kind == 2 and (m := re.match(r"([*#;:]+)\s*(\S.*)", s)):
            body = "- " + clean_inline(m.group(2))
        else:
            body = clean_inline(s) if p >= rewrite else s
        if not body.strip():
            continue
        if out:
            out.append(" " if no == last else "\n" if no == last + 1 else "\n\n")
        out.append(body)
        last = no
    return "".join(out).strip()


def clean_batch(net: BlockLabeller, texts: list[str]) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]]]:
    """Clean texts, and the labels of the blocks that they are made of."""
    resolved = [resolve_constructs(t) for t in texts]
    lines = [leaf_lines(t) for t, _ in resolved]
    labels = net.label([[block_features(p, b) for _, p, b, _ in ls] for ls in lines])
    return [assemble(ls, k, p, kept) for ls, (k, p), (_, kept) in zip(lines, labels, resolved)], labels


def clean_texts(df: DataFrame, keys: list[str], text: str, net: BlockLabeller | None = None) -> DataFrame:
    """Rows (keys, clean_text, headings, lists, code_blocks, residue_blocks) of every text that isn't null; repeated rows come once.

    Each distinct text is labelled and rewritten once, however many rows hold it: texts are told apart by two hashes of 64 bits, by which the rows get
    their results back.
    """
    ship(df.sparkSession)
    parameters = df.sparkSession.sparkContext.broadcast((net or fit(df, keys, text)).p)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = _restore(parameters)
        for batch in batches:
            made, labels = clean_batch(net, batch.column(2).to_pylist())
            count = lambda kind: pa.array([int((k == kind).sum()) for k, _ in labels], pa.int32())
            left = pa.array([int((p >= RESIDUE).sum()) for _, p in labels], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string()), count(1), count(2), count(3), left], ["h1", "h2", "clean_text", "headings", "lists", "code_blocks", "residue_blocks"])

    rows = df.where(F.col(text).isNotNull()).select(*keys, F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2"), F.col(text).alias("t"))
    texts = rows.groupBy("h1", "h2").agg(F.any_value("t").alias("t"))
    made = texts.mapInArrow(run, "h1 long, h2 long, clean_text string, headings int, lists int, code_blocks int, residue_blocks int")
    return rows.select(*keys, "h1", "h2").distinct().join(made.hint("merge"), ["h1", "h2"]).drop("h1", "h2")
