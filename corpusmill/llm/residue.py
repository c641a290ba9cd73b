"""Documents that hold template residue, filler, error pages or access notices where an article should be.

A naive Bayes classifier of passages is learned from positive and unlabelled records by expectation-maximization. Positives are
trusted records: passages of a bounded sample in which a residue grammar finds a form for certain, and records made from such forms.
All other passages are unlabelled. Features are words, signs and classes of both, alone, in pairs, and by twos around a third; words
that the sample doesn't tell about count by their letter trigrams. In each round the classifier of one half of the documents scores the
passages of the other half, a logistic curve over a passage's sums and best windows turns the scores into the probability of
residue, and the classifier is fitted again with these probabilities. A document is a case when one of its passages has a probability from
the threshold on. The grammar labels passages for the fit and has no other use.

Defined cases
    Null, empty and blank texts are no cases. Very long texts are scored whole. Repeated rows of an id give it as often. Wiki
    links and filled templates are no residue. An empty table gives no rows; a sample without positives still has the made
    records. Only the id and text columns are read.
"""

from __future__ import annotations

import pickle
import random
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusmill.runtime import ship

#: Documents of the fitting sample at most, and made records beside them, no more than two for each document and a few hundred.
SAMPLE, MADE = 6000, 1600
#: Rounds of expectation-maximization, widths of windows, and the probability from which a passage is residue.
ROUNDS, WIDTHS, THRESHOLD = 2, (1, 2, 3, 5, 8), 0.5
#: The sightings that less context counts for, how much of the share of residue in all tokens must be possible for more context
#: to be asked, and the sightings of a context outside residue from which it is kept.
PRIOR, GATE, LEAST = 2.0, 1.0, 3

# The forms of unfilled places in common template languages, and of values that failed to render.
UNFILLED = [
    r"\{\{\{[^{}\n]*\}\}\}",  # wiki arguments
    r"\{\{\s*[a-z]\w*(?:[._]\w+)+\s*(?:\|[^{}\n]*)?\}\}",  # {{ page.title }}, {{ page_title }}
    r"\{\{\s*#\w+:[^{}\n]*\}\}",  # parser functions
    r"\{%[^%\n]*%\}", r"<%=?[^%\n]*%>", r"<\?(?:php|=)[^?\n]*\?>",
    r"\$\{[^{}\n]+\}", r"#\{[^{}\n]+\}", r"\$\[[A-Za-z_][\w.]*\]", r"%\([A-Za-z_]\w*\)[sdrf]", r"(?<![\w%])%[sd](?!\w)",
    r"(?<![\w{$#%])\{(?:[A-Za-z_]\w*|\d{1,2})\}(?!\})", r"%%[A-Z_][A-Z0-9_]*%%", r"@@[A-Za-z_]\w*@@", r"(?<!\w)__[A-Z][A-Z0-9_]*__(?!\w)", r"«[A-Z][A-Z0-9_ ]*»", r"<[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+>",
    r"\[(?:INSERT|insert|Insert|YOUR|Your|your|ADD|Add|add)\b[^\[\]\n]*\]", r"\[[a-z]+ (?:name|title|date|text|here)\]", r"<!--[^>\n]*\bgoes here\b[^>\n]*-->",
    r"\((?:add|insert|fill in|describe|write)\b[^()\n]+\)", r"\bTO-?DO\b\s*:", r"\bTBD(?:\s+TBD)+\b", r"\b(?:TBD|FIXME)\b\s*[:.]", r"\bX{4,}\b.*?\bX{4,}\b", r"\bDescribe the \w+ in \w+(?: or \w+)? sentences\b",
    r"\[object Object\]", r"\bNaN [a-z]+ from (?:null|undefined|NaN)\b", r"\bundefined \w+ of (?:undefined|null)\b", r"\b(?:null|undefined|NaN) (?:null|undefined|NaN)\b", r"#(?:REF|NAME|VALUE|DIV/0|N/A)[!?]",
]
# Sentences that stand where text is still to come.
TO_COME = [
    r"\bcontent to follow\b", r"^\s*coming soon\b", r"\b(?:text|content|article text|description) (?:will|shall) (?:appear|follow|be added)\b", r"\bthis is (?:a )?placeholder (?:content|text)\b", r"\bparagraph text paragraph text\b",
    r"\btexte? à venir\b", r"\bhier steht später\b", r"\b(?:sample text|your text|text goes here)\b(?:[\s.,]*\b(?:sample text|your text|text goes here)\b)+", r"\bhere(?:'s| is) some (?:sample|dummy|placeholder) text\b",
    r"здесь будет (?:текст|статья)", r"текст (?:скоро )?появится", r"ここに(?:本文|テキスト|文章)", r"(?:本文|準備中|近日公開)(?:は|です|。)", r"\b(?:Platzhaltertext|Beispieltext|Blindtext|Text folgt|Inhalt folgt)\b", r"\btexte (?:de remplissage|d'exemple)\b", r"текст-заполнитель|заполнить позже",
]
# What servers and wikis say instead of a page.
ERRORS = [
    r"\b(?:page|article|entry|title|file) (?:was |is )?not found\b(?! on that)", r"^\s*(?:Error )?[45]\d\d[ :.–-]+(?:Not Found|Forbidden|Bad Gateway|Internal Server Error|Service Unavailable|Gateway|Unauthorized|Bad Request|Gone|Too Many)", r"^\s*access denied\b\.?", r"^\s*forbidden\b",
    r"\bbad gateway\b", r"\binternal server error\b", r"\bservice (?:temporarily )?unavailable\b", r"\bgateway time-?out\b", r"\btoo many requests\b\.?\s*(?:$|\n|your|wait|please|try)", r"\byour client has been limited\b",
    r"(?:Revision \d+ of|Article|This entry|Your request for|The requested title|The page|The requested page|The article|The entry)[ ,]+(?:\S+[ ,]+){0,6}?(?:cannot be displayed|could not be (?:loaded|displayed|found|rendered)|failed to (?:render|load)|has been (?:removed|deleted|moved)(?: or renamed)?|is (?:unavailable|locked for you)|returned an empty reply|timed out|was not found)(?:[ .!(]|$)",
    r"\bthe page you (?:were|are) looking for\b", r"\bthis page has been (?:deleted|removed|moved)\b", r"\bthe deletion log for\b", r"\bthere is currently no text in this page\b", r"\byou can search for \S+ in other pages\b", r"\boops, something (?:broke|went wrong)\b",
    r"\bthis site is experiencing technical difficulties\b", r"\bcannot reach the \w+ server\b", r"\bthe wiki is having trouble\b", r"\bscheduled maintenance\b", r"\bdatabase error\b\s*:", r"^\s*(?:PHP )?(?:fatal|parse) error\s*:", r"\bTraceback \(most recent call last\)", r"\bException in thread\b", r"^\s*\w+(?:Error|Exception): ",
    r"^\s*File \"[^\"\n]+\", line \d+", r"^\s*at [\w.$/]+\([\w.:]+:?\d+\)", r"\{\s*\"error\"\s*:", r"\bon line \d+\s*$", r"\bout of memory \(tried to allocate\b", r"\bNullReference(?:Exception)?\b", r"\bYour session has expired\b", r"\byou do not have permission to view\b", r"\berrno \d+\b",
    r"\bSeite (?:wurde )?nicht gefunden\b", r"\bDie Seite \S+ existiert nicht\b", r"\bexistiert nicht oder wurde verschoben\b", r"\bErreur \d{3}\b", r"\best introuvable\b", r"\bpage introuvable\b", r"ページが見つかりません", r"見つかりませんでした", r"アクセスが拒否", r"страница не найдена", r"доступ запрещ[её]н", r"ошибка (?:сервера|\d{3})", r"запрошенная страница", r"\bZugriff verweigert\b", r"\baccès refusé\b",
    r"(?:サーバー|内部)エラー", r"\bServerfehler\b", r"\berreur (?:interne|du serveur)\b", r"внутренняя ошибка",
]
# Conditions that are set before an article is shown.
NOTICES = [
    r"\b(?:enable|activate|allow|turn on|switch on|unblock|requires?|need|needs|require|check that|without)\b[^.!?\n\"“”]*\b(?:java ?scripts?|scripts?|script support|active scripting|client-side code|cookies)\b(?=(?P<tail>[^\"\n]*))",
    r"\b(?:java ?scripts?|scripting|cookies) (?:is|are|must be|has to be|have to be) (?:disabled|enabled|required|needed|turned off|off|switched off|blocked|allowed)\b", r"\bwe use scripts to (?:render|show)\b", r"\bnoscript\s*:", r"\bcontent of this \w+ is drawn by script\b", r"\byour browser is (?:out of date|not supported|too old)\b",
    r"\bchecking your browser\b", r"\bverify (?:that )?you are (?:a )?human\b", r"\bad ?blocker (?:found|detected)\b", r"\blog in to (?:continue|read|view)\b", r"\bsign in to (?:continue|read|view)\b", r"\bsubscribe to (?:continue|read)\b", r"\baccept (?:all )?cookies to\b", r"\bthis (?:may|can) take a few seconds\b",
    r"\bBitte (?:aktivieren|schalten) Sie\b", r"\bVeuillez activer\b", r"(?:включите|разрешите|активируйте)\s+(?:JavaScript|сценарии|скрипты|cookies?)", r"(?:JavaScript|スクリプト|クッキー)を有効", r"\bto continue, (?:please )?(?:enable|allow|accept|turn on|switch on|unblock)\b",
]
# One of these is in every line in which a statement of the three lists above can stand; they spare the search in most lines.
HINTS = (
    "to follow", "coming soon", "will ", "shall ", "placeholder", "paragraph text", "venir", "hier steht", "your text", "sample text", "text goes", "some ", "будет", "появится", "ここに", "本文", "準備中", "近日公開", "platzhalter", "beispieltext", "blindtext", "folgt", "texte", "заполн",
    "not found", "forbidden", "gateway", "server error", "unavailable", "unauthorized", "bad request", "gone", "too many", "access denied", "been limited", "cannot be", "could not be", "failed to", "has been", "is locked", "empty reply", "timed out", "page you", "deletion log", "currently no text", "other pages", "oops",
    "difficulties", "cannot reach", "trouble", "maintenance", "error", "traceback", "exception", "file \"", "on line", "out of memory", "nullreference", "expired", "permission", "errno", "seite", "existiert", "introuvable", "erreur", "見つかり", "アクセス", "не найдена", "доступ", "ошибка", "запрошенная", "zugriff", "accès", "エラー", "serverfehler", "внутренняя",
    "script", "cookies", "client-side", "browser", "human", "blocker", "log in", "sign in", "subscribe", "a few seconds", "bitte", "veuillez", "включите", "разрешите", "активируйте", "スクリプト", "クッキー", "to continue",
)
_lorem = "lor ip sum sit am et con sec te tur adi pis cing tris ped mal nus vel quam ora rem do lo dolor ipsum lorem amet elit".split()
_mash = "asdf qwer jkl foo bar blah test xx baz qux asdfasdf zxcv".split()
_syllables = re.compile(rf"(?:{'|'.join(sorted(_lorem, key=len, reverse=True))})+", re.I)
_keys = re.compile(rf"(?:{'|'.join(sorted(_mash, key=len, reverse=True))})+", re.I)
_repeated = re.compile(r"(?<!\w)(?:[xX]{8,}|(?:(?:n/a|tbd|xxx|tba|todo)[\s,;]+){3,}(?:n/a|tbd|xxx|tba|todo))(?!\w)", re.I)
_letters = re.compile(r"[^\W\d_]+")

_unfilled = re.compile("|".join(UNFILLED))
_stated = re.compile("|".join(TO_COME + ERRORS + NOTICES), re.I | re.M)
_sentence = re.compile(r"[^.!?。]+[.!?。]*")
_quoted = re.compile(r"[\"“„«][^\"“”„«»\n]*[\"”»]")
_token = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]|(?:[^\W\d_\u3040-\u30ff\u3400-\u9fff]+|\d+)[^\S\n]?|\n|(?:([^\w\s])\1*|_+)[^\S\n]?")


def filler(line: str) -> bool:
    """A line made of filler: invented Latin, keyboard mashing, or one short thing over and over."""
    words = _letters.findall(line)
    if len(words) >= 4:
        for made in (_syllables, _keys):
            if sum(bool(made.fullmatch(w)) for w in words) >= 0.9 * len(words) and (made is _keys or line.lower().startswith("lorem") or len(words) >= 5):
                return True
    bare = "".join(line.split())
    if len(bare) >= 8 and (re.fullmatch(r"(?:[xX]{6,}|[-_.=*?#~]{8,})", bare) or re.fullmatch(r"(?:n/a|tbd|xxx|tba|\?|-|todo|null|none){4,}", bare, re.I)):
        return True
    return False


def filler_in(line: str) -> bool:
    """Filler as a whole line, as one of its sentences, or as a run of successive words within it."""
    if filler(line) or any(filler(s) for s in _sentence.findall(line)):
        return True
    words = _letters.findall(line)
    for made, least in ((_syllables, 5), (_keys, 4)):
        run = 0
        for w in words:
            run = run + 1 if made.fullmatch(w) else 0
            if run >= least:
                return True
    return bool(_repeated.search(line))


def certain(text: str) -> list[tuple[int, int]]:
    """The places at which the grammar finds residue for certain; statements between quotation marks aren't."""
    out = [m.span() for m in _unfilled.finditer(text)]
    at = 0
    for line in text.split("\n"):
        if filler_in(line):
            parts = [m.span() for m in _sentence.finditer(line) if filler_in(m.group())] or [(0, len(line))]
            out += [(at + a, at + b) for a, b in parts]
        quoted = None
        low = line.lower()
        for m in _stated.finditer(line) if low.lstrip().startswith("at ") or any(h in low for h in HINTS) else ():
            quoted = [q.span() for q in _quoted.finditer(line)] if quoted is None else quoted
            if not any(a < m.start() and m.end() < b for a, b in quoted):
                out.append((at + m.start(), at + m.end()))
        at += len(line) + 1
    return out


def _form(token: str) -> tuple[str, str]:
    """The class of a token and its own form; both end with a space where space follows."""
    if token == "\n":
        return token, token
    bare = token.rstrip()
    gap = " " if len(bare) < len(token) else ""
    c = bare[0]
    if len(bare) > 5 and len(set(bare)) == 1:
        return c * 6 + gap, c * 6 + gap
    if c.isalpha():
        if c > "\u3040" and len(bare) == 1:
            return "k" + gap, bare + gap
        kind = "v" if len(bare) > 30 else "U" if len(bare) > 1 and bare.isupper() else "T" if c.isupper() else "w"  # v: no usual word
        return kind + gap, bare.lower() + gap
    if c.isdigit():
        return "9" + gap, (bare if len(bare) == 3 and bare[0] in "45" else "9") + gap
    return bare[:4] + gap, bare[:4] + gap


def _mix(*parts: np.ndarray) -> np.ndarray:
    h = np.full(len(parts[0]), len(parts), "uint64")
    for p in parts:
        h = (h ^ p.view("uint64")) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view("int64")


def _trigrams(word: str) -> list[str]:
    p = f"^{word}$"
    return [p[k : k + 3] for k in range(len(p) - 2)]


class _Tokens(dict):
    """Numbers of tokens, with arrays of what they stand for: own code, class code, end of a passage, score of unknown letters."""

    def __init__(self, known: frozenset[str] | None = None, grams: dict[str, float] | None = None):
        super().__init__()
        self.known, self.grams = known, grams or {}
        self.names: list[str] = []
        self.columns = array("q"), array("q"), array("b"), array("d")

    def __missing__(self, token: str) -> int:
        cls, form = _form(token)
        word = form.strip()
        own, score = form, 0.0
        if self.known is not None and word[:1].isalpha() and word not in self.known:
            own = cls
            if len(word) > 1:
                parts = [self.grams.get(g, 0.0) for g in _trigrams(word)]
                score = min(max(sum(parts) / len(parts), -2.0), 2.0)
        ends = token == "\n" or token[0] == "。" or (token[0] in ".!?…" and token[-1].isspace())
        self[token] = k = len(self.names)
        self.names.append(word)
        for column, value in zip(self.columns, (_hash(own), _hash(cls), ends, score)):
            column.append(value)
        return k

    def arrays(self) -> tuple[np.ndarray, ...]:
        own, cls, ends, score = self.columns
        return np.array(own), np.array(cls), np.array(ends, bool), np.array(score)


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _read(texts: list[str], tokens: _Tokens, places: bool = False) -> tuple[np.ndarray, ...]:
    """Token numbers of the texts one after another, and the first place of each text; on demand, where in its text each token begins and ends."""
    ids, docs, begin, end = array("q"), array("q"), array("q"), array("q")
    for text in texts:
        docs.append(len(ids))
        if places:
            for m in _token.finditer(text):
                ids.append(tokens[m.group()])
                begin.append(m.start())
                end.append(m.end())
        else:
            ids.extend([tokens[m.group()] for m in _token.finditer(text)])
    return tuple(np.frombuffer(x, "int64") if len(x) else np.empty(0, "int64") for x in (ids, docs, begin, end))


def _passages(ids: np.ndarray, docs: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of passages, and the text each is of; a text without tokens has none."""
    first = np.zeros(len(ids), bool)
    first[1:] = ends[ids[:-1]]
    first[docs[docs < len(ids)]] = True
    starts = np.flatnonzero(first)
    return starts, np.searchsorted(docs, starts, "right") - 1


def _contexts(ids: np.ndarray, docs: np.ndarray, own: np.ndarray, cls: np.ndarray) -> list[np.ndarray]:
    """The features at each place, each with more context than the one before it: the token; it with the one before; with the one
    after; with the one before the last around that one's class; with the last two; with the last three; with one and two on either side."""
    a, c = own[ids], cls[ids]
    at = docs[docs < len(ids)]

    def moved(x: np.ndarray, n: int) -> np.ndarray:
        """What stands n places before (after, if n is negative), within the text."""
        if n > 0:
            out = np.concatenate([np.zeros(n, "int64"), x])[: len(x)]
            for k in range(n):
                out[at[at + k < len(x)] + k] = 0
        else:
            out = np.concatenate([x, np.zeros(-n, "int64")])[-n:]
            for k in range(-n):
                out[at[at > k] - 1 - k] = 0
        return out

    a1, a2, a3, c1, n1, n2 = moved(a, 1), moved(a, 2), moved(a, 3), moved(c, 1), moved(a, -1), moved(a, -2)
    return [_mix(a), _mix(a1, a), _mix(a, n1, n1), _mix(a2, c1, a), _mix(a1, a, n1), _mix(a2, a1, a), _mix(a1, a, n1, n2), _mix(a3, a2, a1, a)]


def _open(p: np.ndarray, base: float) -> np.ndarray:
    """Places at which residue isn't ruled out, and the two on either side of them."""
    may = p > base * GATE
    wide = may.copy()
    for n in (1, 2):
        wide[n:] |= may[:-n]
        wide[:-n] |= may[n:]
    return np.flatnonzero(wide)


Table = tuple[np.ndarray, np.ndarray, np.ndarray]  # hashes of contexts in order, their sightings in residue, and all of them


def _seen(table: Table, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, yes, n = table
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    hit = keys[at] == hashes
    return np.where(hit, yes[at], 0.0), np.where(hit, n[at], 0.0)


def _corrected(p: np.ndarray | None, table: Table, hashes: np.ndarray, open_: np.ndarray | None, letters: np.ndarray, base: float) -> np.ndarray:
    """The probabilities at the open places, corrected by what was seen in one more context; the first context knows all places."""
    if p is None:
        yes, n = _seen(table, hashes)
        first = (yes + base) / (n + 1)
        return 1 / (1 + (1 - first) / np.maximum(first, 1e-9) * np.exp(-letters))
    yes, n = _seen(table, hashes[open_])
    p[open_] = (yes + PRIOR * p[open_]) / (n + PRIOR)
    return p


def _posterior(tables: list[Table], contexts: list[np.ndarray], letters: np.ndarray, base: float) -> np.ndarray:
    """The probability that the token at each place is residue: with each context, what was seen in it corrects what less context told.

    More context is asked only at and beside tokens that may be residue.
    """
    p = None
    for table, f in zip(tables, contexts):
        p = _corrected(p, table, f, None if p is None else _open(p, base), letters, base)
    return p


def _tables(w: np.ndarray, contexts: list[np.ndarray], letters: np.ndarray, mask: np.ndarray, base: float) -> tuple[list[Table], np.ndarray]:
    """Sightings of each context at the places of the mask, and the posterior that they give at all places."""
    out: list[Table] = []
    p = None
    for f in contexts:
        open_ = None if p is None else _open(p, base)
        use = np.flatnonzero(mask) if open_ is None else open_[mask[open_]]
        keys, code = np.unique(f[use], return_inverse=True)
        yes, n = np.bincount(code, w[use], len(keys)), np.bincount(code, minlength=len(keys))
        keep = (yes > 0.5) | (n >= LEAST)
        keep[:1] = True
        table = (keys[keep], yes[keep].astype("float32"), n[keep].astype("float32")) if len(keys) else (np.zeros(1, "int64"), np.zeros(1, "float32"), np.zeros(1, "float32"))
        out.append(table)
        p = _corrected(p, table, f, open_, letters, base)
    return out, p


def _score(p: np.ndarray, base: float, line_end: np.ndarray) -> np.ndarray:
    """Log odds against those of any token; ends of lines say nothing."""
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.where(line_end, 0.0, np.log(p / (1 - p)) - np.log(base / (1 - base)))


def _summary(score: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """What a passage's scores say: its best windows, its best run, what speaks against residue, and its length."""
    n = len(score)
    held = np.clip(score, -6.0, 8.0).astype("float64")
    total = np.concatenate([[0.0], np.cumsum(held)])
    size = np.diff([*starts.tolist(), n])
    first = np.repeat(starts, size)
    out = []
    for width in WIDTHS:
        sums = total[1:] - total[np.maximum(np.arange(1, n + 1) - width, first)]
        out.append(np.maximum.reduceat(sums, starts))
    # the best run: the running total above its lowest value so far in the passage
    lift = (total.max() - total.min() + 1.0) * np.repeat(np.arange(len(starts)), size)
    low = -np.maximum.accumulate(lift - total[:-1]) + lift
    run = np.maximum.reduceat(total[1:] - low, starts)
    out += [np.sqrt(np.maximum(run, 0.0)), np.minimum.reduceat(held, starts), np.add.reduceat(np.minimum(held, 0.0), starts) / size, np.add.reduceat(held, starts) / size, np.log(size), (size == 1) * 1.0]
    return np.stack([*out, np.ones(len(starts))], 1)


def own_records(rng: random.Random, n: int, nouns: list[str]) -> list[str]:
    """Trusted positives from the grammar's forms, with words of the texts in their open places, so that these tell nothing."""
    forms = [
        "{{{%s}}}", "{{{%s|}}}", "{{ %s_name }}", "{{ page.%s }}", "{{#if:%s|}}", "{%% block %s %%}{%% endblock %%}", "<%%= %s.name %%>", "${%s.name}", "#{%s}", "$[%s]", "%%(%s)s", "{%s}", "%%%%%s%%%%", "@@%s@@", "__%s__", "«%s»", "<%s_NAME>",
        "[INSERT %s HERE]", "[insert %s here]", "[Your %s here]", "[%s name]", "<!-- %s goes here -->", "(add a short description of the %s)", "TODO: write about the %s", "TBD TBD TBD", "XXXX the %s XXXX", "Describe the %s in two or three sentences.",
        "[object Object]", "NaN leagues from null", "undefined %s of undefined", "%%s", "{0}", "{1}", "Content to follow.", "Coming soon.", "Article text will appear here.", "This is placeholder content.", "Paragraph text paragraph text paragraph text.", "Texte à venir.", "Hier steht später der Text.",
        "Sample text your text text goes here sample text", "Page not found", "404 Not Found", "403 Forbidden.", "Access denied", "Bad gateway · upstream did not answer", "Your request for %s could not be loaded.", "The page %s has been removed or renamed.", "This entry %s timed out.", "Revision 12 of %s failed to render.", "Article %s cannot be displayed.", "The requested title %s is locked for you.", "It returned an empty reply.",
        "The page you were looking for has moved or never existed.", "This page has been deleted. The deletion log is provided below.", "There is currently no text in this page. You can search for %s in other pages.", "Oops, something broke while we fetched the %s.", "This site is experiencing technical difficulties.", "Cannot reach the %s server.", "Scheduled maintenance: the wiki is read-only.", "Database error: lost connection while reading table %s (errno 7)", "Fatal error: out of memory in render",
        "Traceback (most recent call last):", "Exception in thread main NullReference: %s.", "KeyError: '%s'", '{"error": {"code": "internal_%s", "info": "request failed"}}', "Too many requests. Your client has been limited; wait 5 seconds.", "Your session has expired.", "You do not have permission to view %s.", "Seite nicht gefunden", "Die Seite existiert nicht oder wurde verschoben.", "Erreur 404 : la page est introuvable.", "ページが見つかりません。アドレスを確認してください。", "Страница не найдена.", "Доступ запрещён.",
        "Please enable JavaScript to view this page.", "You must switch on scripts in your browser.", "Before reading on, unblock script support for this wiki.", "To continue, allow client-side code and reload.", "For the best experience, turn on active scripting in the settings (no content without it).", "This site requires cookies and JavaScript to work properly.", "JavaScript is disabled.", "We use scripts to render the map. Without them nothing can be displayed here.", "Your browser is out of date.", "Checking your browser before you go on.", "Verify that you are human to continue.", "Ad blocker found. Switch it off to read the article.", "Log in to continue reading %s.", "Loading… If nothing happens, check that active scripting is allowed.",
        "Здесь будет текст.", "ここに本文が入ります。", "Bitte aktivieren Sie JavaScript, um fortzufahren.", "Veuillez activer JavaScript dans votre navigateur.", "Для просмотра включите JavaScript.", "JavaScriptを有効にしてください。", "n/a n/a n/a n/a n/a n/a n/a", "xxxxxxxxxxxxxxxxxxxxxxx", "? ? ? ? ? ? ? ? ?", "---------------------", "................", "xxxxxxxx", "このページを表示するにはスクリプトを有効にしてください。",
    ]
    out = []
    for k in range(n):
        form = forms[k % len(forms)]
        noun = rng.choice(nouns)
        text = form.replace("%%", "\0").replace("%s", noun.upper() if re.search(r"__%s|«%s|<%s|%%%%%s|INSERT", form) else noun).replace("\0", "%")
        if rng.random() < 0.3:
            text = " ".join("".join(rng.choice(_lorem) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(6, 20))) if rng.random() < 0.6 else " ".join(rng.choice(_mash) for _ in range(rng.randint(6, 16)))
        out.append(text)
    return out


class Model:
    """Sightings by context, words and trigrams that are known, and the logistic curve over a passage's summary."""

    def __init__(self, tables: list[Table], base: float, known: frozenset[str], grams: dict[str, float], curve: np.ndarray, scale: np.ndarray):
        self.tables, self.base, self.known, self.grams, self.curve, self.scale = tables, base, known, grams, curve, scale

    def probabilities(self, texts: list[str], tokens: _Tokens | None = None) -> np.ndarray:
        """The highest probability of residue among the passages of each text; 0 for a text without any."""
        tokens = _Tokens(self.known, self.grams) if tokens is None else tokens
        out = np.zeros(len(texts))
        ids, docs, *_ = _read(texts, tokens)
        if len(ids):
            own, cls, ends, letters = tokens.arrays()
            starts, text = _passages(ids, docs, ends)
            score = _score(_posterior(self.tables, _contexts(ids, docs, own, cls), letters[ids], self.base), self.base, cls[ids] == _hash("\n"))
            z = (_summary(score, starts) / self.scale) @ self.curve
            np.maximum.at(out, text, 1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return out

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            pickle.dump((self.tables, self.base, self.known, self.grams, self.curve, self.scale), f)

    @staticmethod
    def load(path: str) -> Model:
        with open(path, "rb") as f:
            return Model(*pickle.load(f))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 25) -> np.ndarray:
    """Newton's method with a small ridge."""
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (y - p)) - 0.1 * b
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 0.1 * np.eye(len(b))
        step = np.linalg.solve(curve, grad)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    return b


def fit(texts: list[str], spots: list[list[tuple[int, int]]] | None = None, rounds: int = ROUNDS, seed: int = 1, made: int = MADE) -> Model:
    """Expectation-maximization over the passages of the texts; trusted passages keep their label, the others are residue with a probability.

    spots: for each text the places that are certain, by default those of the grammar.
    """
    rng = random.Random(seed)
    usual = Counter(w for t in texts for w in t.split() if len(w) > 3 and w.isalpha() and w.islower())
    records = own_records(rng, min(made, 300 + 2 * len(texts)), sorted(w for w, n in usual.items() if n > 5) or ["name"])
    every = [*texts, *records]
    tokens = _Tokens()
    ids, docs, begin, end = _read(every, tokens, places=True)
    own, cls, ends, _ = tokens.arrays()
    starts, text = _passages(ids, docs, ends)
    size = np.diff([*starts.tolist(), len(ids)])
    row = np.repeat(np.arange(len(starts)), size)
    # a trusted token lies in a place that is certain
    sure = np.zeros(len(ids), bool)
    sure[docs[len(texts)] if len(texts) < len(docs) else len(ids) :] = True
    for d, found in enumerate([certain(t) for t in texts] if spots is None else spots):
        a, b = docs[d], docs[d + 1] if d + 1 < len(docs) else len(ids)
        for s, e in found:
            sure[a + np.searchsorted(end[a:b], s, "right") : a + np.searchsorted(begin[a:b], e, "left")] = True
    trusted = np.maximum.reduceat(sure, starts)
    fold = (text * 2654435761 >> 7) % 2

    def known_words(w: np.ndarray) -> frozenset[str]:
        """Words that keep their own form: those that are usual, or that tell of residue."""
        number: dict[str, int] = {}
        code = np.array([number.setdefault(n, len(number)) for n in tokens.names])
        values = np.array(list(number), dtype=object)
        yes, no = np.bincount(code[ids], w, len(values)), np.bincount(code[ids], 1 - w, len(values))
        odds = np.log((yes + 0.5) / (w.sum() + 1)) - np.log((no + 0.5) / ((1 - w).sum() + 1))
        keep = ((yes + no >= 3) & (odds > 0)) | (yes + no > max(3, 0.0005 * len(ids)))
        return frozenset(values[keep].tolist())

    def letters_of(w: np.ndarray) -> dict[str, float]:
        """Log odds of the letter trigrams of all words."""
        yes, no = np.bincount(ids, w, len(tokens.names)), np.bincount(ids, 1 - w, len(tokens.names))
        table: dict[str, list[float]] = {}
        for word, y, n in zip(tokens.names, yes.tolist(), no.tolist()):
            if word[:1].isalpha() and len(word) > 1:
                for g in _trigrams(word):
                    held = table.setdefault(g, [0.5, 0.5])
                    held[0] += y
                    held[1] += n
        a, b = sum(v[0] for v in table.values()), sum(v[1] for v in table.values())
        return {g: float(np.log(y / a) - np.log(n / b)) for g, (y, n) in table.items()}

    w = np.where(sure, 1.0, 0.0)
    for _ in range(rounds):
        known, grams = known_words(w), letters_of(w)
        seen = _Tokens(known, grams)
        for token in tokens:
            seen[token]
        own, cls, _, letters = seen.arrays()
        contexts, letters, base = _contexts(ids, docs, own, cls), letters[ids], min(float(w.mean()), 0.5)
        score = np.zeros(len(ids))
        for side in (0, 1):
            mine = fold[row] == side
            score[mine] = _score(_tables(w, contexts, letters, ~mine, base)[1], base, cls[ids] == _hash("\n"))[mine]
        summary = _summary(score, starts)
        scale = np.maximum(summary.std(0), 1e-3)
        scale[-1] = 1.0
        curve = _logistic(summary / scale, trusted.astype(float), np.where(text >= len(texts), 0.3, 1.0))
        z = (summary / scale) @ curve
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        # an unlabelled token is residue as far as its passage is, and it itself tells so
        w = np.where(sure, 1.0, (p[row] * (score > 0)).astype("float64"))
    return Model(_tables(w, contexts, letters, np.ones(len(ids), bool), base)[0], base, known, grams, curve, scale)


def labelled_sample(df: DataFrame, key: str, text: str, size: int = SAMPLE) -> tuple[list[str], list[list[tuple[int, int]]]]:
    """The fitting sample: the `size` texts of the lowest hashes, and the places in them that are certain, found on the executors."""
    rows = df.where(F.col(text).isNotNull() & (F.trim(text) != "")).select(F.xxhash64(key, text).alias("h"), F.col(text).alias("t"))
    share = int(min(1.0, 1.5 * size / max(rows.count(), 1) + 1e-4) * (1 << 20)) - (1 << 19)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = [[x for s in certain(t) for x in s] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spots, pa.list_(pa.int32()))], ["h", "t", "spots"])

    near = rows.where(F.shiftright("h", 44) <= share).orderBy("h", "t").limit(size).repartition(df.sparkSession.sparkContext.defaultParallelism)
    found = sorted(near.mapInArrow(label, "h long, t string, spots array<int>").collect())  # at most `size` rows
    return [r.t for r in found], [list(zip(r.spots[::2], r.spots[1::2])) for r in found]


def residue_documents(df: DataFrame, key: str, text: str, model: Model | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (key, probability) of the documents with a passage of at least the threshold's probability.

    A model that is given is used; without one, one is fitted on the table first.
    """
    ship(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model or fit(*labelled_sample(df, key, text)))  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        tokens = _Tokens(model.known, model.grams)
        for batch in batches:
            if len(tokens) > 500_000:
                tokens = _Tokens(model.known, model.grams)
            p = model.probabilities([t or "" for t in batch.column(1).to_pylist()], tokens)
            found = np.flatnonzero(p >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found)), pa.array(p[found])], [key, "probability"])

    return df.where(F.col(text).isNotNull()).select(key, text).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, probability double")
