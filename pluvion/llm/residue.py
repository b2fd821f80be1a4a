"""Template residue, filler, error pages and script notices in place of content (problem 9).

Labelled exemplars of residue, ``EXEMPLARS``, are indexed by their words and pairs of neighbouring words. A document is split into its message and its diff; each
is unwrapped into passages (sentences), and windows of ``WINDOW`` words are moved over each passage. For every window the index retrieves the exemplars that share
words or pairs with it. The window's containment in those of one label is the share of its TF-IDF weight that their words cover, and the share that their
pairs cover; document frequencies are those of the whole corpus. A part of a document is residue when contained windows cover nearly all of its weight.
Template fields are read as one word of its own, digits and pseudo-Latin words too; a window with a field is held against forms to be filled in, and against
sentences that talk about fields.
"""

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvion.llm.texts import INVISIBLE, TAG
from pluvion.sources.tables import table

#: The labelled sample, one exemplar a line. Pages, notices and filler stand for content that is not there; forms are to be filled in; mentions
#: talk about fields; doodles are filler where there are three words at least. The sample is bounded by being written out here.
EXEMPLARS = {
    "page": """
HTTP status 9 error 9 detail bad request, gone, not found, page not found, bad gateway, gateway timed out, gateway time-out, timeout, too many requests, forbidden, unauthorized
Access denied. Sign-in needed. Sign in to continue. Login required. 9 forbidden unauthorized HTTP error status detail
9 Service unavailable. Service temporarily unavailable. Internal server error. Bad gateway. nginx apache cloudflare openresty varnish HTTP error status
Oops! Something went wrong on our side. Whoops, looks like something went wrong. We're sorry, but something went wrong. An unexpected error occurred. Please try again later.
An error occurred while processing your request. Your request could not be processed, has been blocked. Attention required! cloudflare
The server is temporarily unable to service your request due to maintenance downtime or capacity problems. Please try again later. Service unavailable.
This site, page, content is under maintenance, under construction, coming soon, not available right now. Check back soon.
Sorry, we couldn't find that page. Page not found. The link may be broken, or the page may have been removed.
You must be logged in to view this page. Please log in to continue. You don't have permission to access this page, server. Access denied.
Loading, please wait...
Sorry, you have been rate limited. Too many requests. Slow down and try again in a few minutes.
Traceback (most recent call last): render(commit) RenderTimeout TemplateFault BackendGone: could not render this page
Try again in a few minutes. If this keeps happening, contact the site owner or administrator. Reference: idtoken
Your session has ended, log in again. Your session has expired, has timed out, please sign in again. Access denied.
The upstream did not answer in time. The server did not respond in time. The request timed out. The connection timed out.
The diff service is down for maintenance. The site is temporarily down for scheduled maintenance, please check back later. We are currently performing maintenance.
We could not load this commit. We could not load or show this page, file, diff. Failed to load. Reload the page.
Error establishing a database connection.
The page you are looking for does not exist, was moved or removed. This page has moved or no longer exists. The page you requested could not be found. Sorry, this page is not available.
The requested URL was not found on this server. The requested resource could not be found. You do not have permission to access this resource on this server.
This site can't be reached. This page isn't working. The connection was reset. Check your connection.
Application error: an exception has occurred, see the browser console for more information.
Checking your browser before opening the repository... Verifying that you are human. Just a moment, please wait.
Seite nicht gefunden. Bitte prüfen Sie die Adresse. Zeitüberschreitung des Servers. Der Server antwortet nicht. Der Dienst ist vorübergehend nicht erreichbar.
Page introuvable. Revenez à l'accueil. Le serveur n'a pas répondu à temps. Délai d'attente dépassé. Le service est indisponible pour le moment.
Página no encontrada. Vuelva al inicio. Se agotó el tiempo de espera del servidor. El servicio no está disponible en este momento.
Страница не найдена. Проверьте адрес. Вернитесь на главную. Сервер не ответил вовремя. Сервис временно недоступен.
""",
    "notice": """
Our code browser, the diff viewer, the commit view, this site, this page, this app requires JavaScript and cookies, needs JavaScript to run
Our code browser, the diff viewer, the commit view, this site page, works only with scripts switched on
Our code browser, the diff viewer, the commit view, this site page, depends on JavaScript, which your browser has disabled
Our code browser, the diff viewer, the commit view, this site page, cannot be shown because scripts are blocked
You need to enable JavaScript to run this app. Please enable JavaScript to continue, to view or use this page, site, application. JavaScript is required.
Please enable scripts and refresh. Please turn it on, turn JavaScript on, allow scripts and reload the page. Allow scripts for this host to continue.
JavaScript is disabled or not supported in your browser. Please enable it, and cookies, in your browser settings and try again.
JavaScript must be enabled in order to use this site. JavaScript is turned off. This site requires JavaScript to be enabled. Your browser does not support JavaScript. Enable JavaScript and cookies to continue.
Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen. Diese Ansicht braucht aktivierte Skripte.
Activez JavaScript pour voir cette page. Cette vue exige que les scripts soient autorisés.
Active JavaScript para ver este cambio, esta página. Esta vista necesita que los scripts estén permitidos.
Включите JavaScript, чтобы увидеть страницу. Для просмотра нужны включённые скрипты.
""",
    "filler": """
Text goes here. Your text here. Some text to be written. Content to follow. Sample text. Placeholder text. Insert text here. Lorem ipsum
Heading one. Heading two. Paragraph one. Paragraph two.
This is only sample wording to fill the space. This text is a placeholder, to be replaced later.
TODO: describe your changes here. Please describe the change. Add a description. Enter a title, message or summary here. Write something.
Insert a description here. Title of the change goes here. Please describe your changes and why they are needed.
Please enter the commit message for your changes. Lines starting with # will be ignored, and an empty message aborts the commit.
Hier steht bald ein Text. Hier folgt der Text.
Texte à venir. Insérer le texte ici.
Texto de relleno. Escriba el texto aquí.
latinword latinword lorem ipsum dolor sit amet consectetur elit sed ut et in
""",
    "form": """
ticket field
owner field
reported in field by field
see field and field for details
hello field, please look at field before field
closes field, requested by field
fixes field
release field of
sync to field
label field
field
""",
    "mention": """
escape field in the mail template
read field from the environment
rename field in the template
document the field placeholder
replace field with
""",
    "doodle": """
aaa bar baz bla blah foo qwer test xxx zzz asdf qwe zxc rty fghj jkl vbnm qwerty asdfgh
""",
}
#: The syllables of pseudo-Latin.
SYLLABLES = "lorem ipsum dolor sit amet consectetur cons adip elit sed tempor temp inc incididunt ut labore lab et dol dolore mag magna aliqua ali enim ven veniam quis qua nost nostrud ull ullamco lor ect ectetur iscing a or um is es us e i o".split()
#: How an unfilled field is written.
FIELD = re.compile(
    r"\{\{\s*[\w.]+\s*\}\}|\$\{\w+\}|#\{[\w.]+\}|%\(\w+\)s|<%=?\s*\w+\s*%>|<!--[^<>]*?-->|<(?i:insert|your|enter|add|describe) [\w ]+>|<[A-Z_]{3,}>"
    r"|\[[\w ]+ (?:goes )?here\]|\[(?:YOUR|your|insert|INSERT) [\w ]+\]|__[A-Z]{3,}__|@@[A-Z]{3,}@@|(?<![{$#\w])\{[a-z_]{3,}\}"
)
#: Numbers, and servers that sign their pages.
BETWEEN = {"9", "nginx", "apache", "cloudflare", "openresty", "varnish"}
#: Words of a window.
WINDOW = 8
#: Containment of a window by words and by pairs of words, and share of a part's weight that such windows must cover.
CONTAINMENT, SIDES, COVERAGE = 0.75, 0.4, 0.8
#: Pairs of words under which a window must have all of its pairs in exemplars.
FEW = 3
#: Containment of a window with a field in a form, and of one in a form that has words of its own and stands whole in the window, with other words in between.
FORM, FILLED = 0.8, 0.45
#: Words of six letters or more made of syllables alone that make a part pseudo-Latin; words of a doodle.
LATIN_WORDS, DOODLE = 3, 3
#: What stands for content that is not there.
RESIDUE = ("page", "notice", "filler")

_FEATURE = re.compile(r"\w+")
_REFERENCE = re.compile(r"\b[Rr]eference: \w+")
#: Up to four words, a colon, a dash or the end of bold type, and nothing but fields after it.
_LABEL = re.compile(r"\W*\w+(?:[ \t'-]+\w+){0,3}\s*(?::|[-\u2013\u2014](?=\s)|\*\*:?|__:?)[\s*_:]*(?:\x02[\s,.]*)+")
_PICKED = re.compile(r"(?m)^\s*\(cherry picked from commit [0-9a-f]+\)\s*$")
_MOJIBAKE = re.compile("[ÃÂÐÑ]")
_LATIN = re.compile("(?:" + "|".join(sorted(SYLLABLES, key=len, reverse=True)) + ")+")


def features(passage: str, latin: bool = False) -> list[str]:
    """Lower-case words; a field, digits and, where the part is pseudo-Latin, words of syllables are one word each, and so is a long mixed token after "Reference"."""
    t = _REFERENCE.sub("reference idtoken", passage)
    t = "label \x02" if "\x02" in t and _LABEL.fullmatch(t) else t
    t = (t.replace("\x02", " \u0192field ") if "\x02" in t else t).lower()
    fs = ["9" if w.isdigit() else w for w in _FEATURE.findall(t)]
    return ["latinword" if latin and _LATIN.fullmatch(w) else w for w in fs]


def exemplars() -> list[tuple[str, frozenset[str], frozenset[tuple[str, str]]]]:
    """Label, words and pairs of words of every exemplar. In a form or a mention the word "field" is a field."""
    out = []
    for label, texts in EXEMPLARS.items():
        for t in texts.strip().split("\n"):
            t = re.sub(r"\bfield\b", "\x02", t) if label in ("form", "mention") else t
            clauses = [features(c) for c in re.split(r"[.,;!?()]+", t)]
            out.append((label, frozenset(features(t)), frozenset(p for c in clauses for p in pairs(c))))
    return out


def vocabulary() -> list[str]:
    return sorted(set().union(*(words for _, words, _ in exemplars())))


def repaired(text: str) -> str:
    """Garbled accents set right where the whole text can be."""
    if _MOJIBAKE.search(text):
        for codec in ("cp1252", "latin-1"):
            try:
                return text.encode(codec).decode("utf-8")
            except UnicodeError:
                pass
        # each garbled stretch alone, where the rest holds letters that the codec lacks
        return re.sub(r"[Â-ôÀ-ÿ][\u0080-¿–-›Œ-žˆ˜€™]{1,3}", lambda m: _stretch(m[0]), text)
    return text


def _stretch(s: str) -> str:
    try:
        return s.encode("cp1252").decode("utf-8")
    except UnicodeError:
        return s


def parts(text: str | None) -> tuple[str, str]:
    """Message and diff of a commit, without headers; all of the text is the message where no layout shows."""
    t = repaired((text or "").lstrip("﻿")).replace("\r\n", "\n").replace("\r", "\n").translate(INVISIBLE)
    m = re.match(r'\s*\{.*?"message": "((?:[^"\\]|\\.)*)"(?:, "diff": "((?:[^"\\]|\\.)*)")?', t, re.S)
    if m:
        undo = lambda s: re.sub(r"\\u([0-9a-f]{4})", lambda u: chr(int(u[1], 16)), s.replace("\\n", "\n").replace('\\"', '"').replace("\\t", "\t").replace("\\r", "\n"))
        return undo(m[1]), undo(m[2] or "")
    m = re.match(r"commit [0-9a-f]{7,}\n(?:[A-Z]\w+: .*\n)*\n?((?:(?: {4}.*|[ \t]*)\n|    .*$)*)", t)
    if m:
        return m[1], t[m.end() :]
    m = re.match(r"From [0-9a-f]{7,}.*\n(?:(?!Subject)[A-Z][\w-]*: .*\n)*Subject: (?:\[PATCH[^\]]*\] ?)?(.*?)(?:\n---\n|\n---$|$)", t, re.S)
    if m:
        return m[1], re.sub(r"\n-- \n[\d.]+\s*$|^-- \n[\d.]+\s*$", "", t[m.end() :])
    m = re.search(r"(?:^|\n)\S+ committed on [-\d]+[ \t]*(?:\n|$)", t)
    if m:
        return t[: m.start()], t[m.end() :]
    m = re.search(r"(?:^|\n)diff --", t)
    return (t[: m.start()], t[m.start() :]) if m else (t, "")


def passages(part: str) -> list[str]:
    """Sentences, whatever the line breaks. A blank line, a tag, a quoted string and a line that begins with a capital start a new one."""
    out = []
    for paragraph in re.split(r"\n\s*\n|[\"{}]+", TAG.sub("\n\n", part)):
        joined = re.sub(r"\s*\n\s*(?=[A-ZА-Я<{*#\x02-])", "\u0001", paragraph.strip())
        out += re.split(r"\u0001|(?<=[.!?…])\s+", re.sub(r"\s+", " ", joined))
    return [p for p in out if p.strip()]


def windows(fs: list[str]) -> list[tuple[int, list[str]]]:
    """Every stretch of ``WINDOW`` words with its place; a shorter passage is one window."""
    return [(i, fs[i : i + WINDOW]) for i in range(max(1, len(fs) - WINDOW + 1))]


def pairs(fs: list[str]) -> list[tuple[str, str]]:
    """Words that stand side by side; numbers and names of servers between them do not count."""
    ws = [w for w in fs if w not in BETWEEN]
    return list(zip(ws, ws[1:]))


class Index:
    """Inverted index of the exemplars, by their words and pairs of words, with the weights of the words."""

    def __init__(self, weights: dict[str, float], unseen: float) -> None:
        self.exemplars, self.weights, self.unseen = exemplars(), weights, unseen
        self.whole = [sum(map(self.weight, ws)) for _, ws, _ in self.exemplars]
        self.postings: dict[str | tuple[str, str], list[int]] = {}
        for n, (_, ws, ps) in enumerate(self.exemplars):
            for w in ws | ps:
                self.postings.setdefault(w, []).append(n)
        self.known = {labels: {w for label, ws, _ in self.exemplars if label in labels for w in ws} for labels in (RESIDUE, ("doodle",))}

    def weight(self, w: str) -> float:
        return self.weights.get(w, self.unseen)

    def containments(self, window: list[str]) -> dict[int, float]:
        """The share of a window's weight that each exemplar covers by its words, of those that share a word with it."""
        score: dict[int, float] = {}
        total = 0.0
        for w in window:
            x = self.weight(w)
            total += x
            for n in self.postings.get(w, ()):
                score[n] = score.get(n, 0.0) + x
        return {n: x / total for n, x in score.items()}

    def best(self, window: list[str], labels: tuple[str, ...]) -> float:
        return max((x for n, x in self.containments(window).items() if self.exemplars[n][0] in labels), default=0.0)

    def contained(self, window: list[str], labels: tuple[str, ...]) -> bool:
        """Whether the exemplars of one label that the window retrieves cover enough of its words, and of its pairs of words (of a few, all). A pair weighs as its lighter word."""
        ps = [] if labels == ("doodle",) else pairs(window)
        word_total, pair_total = sum(map(self.weight, window)), 0.0
        words: dict[str, float] = {}
        sides: dict[str, float] = {}
        for features, got in ((window, words), (ps, sides)):
            for f in features:
                x = self.weight(f) if got is words else min(map(self.weight, f))
                pair_total += x if got is sides else 0.0
                for label in {self.exemplars[n][0] for n in self.postings.get(f, ())}:
                    got[label] = got.get(label, 0.0) + x
        need = (SIDES if len(ps) >= FEW else 1.0) * pair_total * (1 - 1e-9)
        return any(words.get(k, 0.0) >= CONTAINMENT * word_total and sides.get(k, 0.0) >= need for k in labels)

    def may_be(self, fs: list[str], labels: tuple[str, ...]) -> bool:
        """Whether the known words weigh enough: without that no windows can be contained and cover as much as is asked for."""
        known, get = self.known[labels], self.weights.get
        return sum(get(w, self.unseen) for w in fs if w in known) >= CONTAINMENT * COVERAGE * sum(get(w, self.unseen) for w in fs)

    def covered(self, parts: list[list[str]], labels: tuple[str, ...]) -> bool:
        """Whether windows contained in exemplars of the labels cover nearly all of the weight of the passages."""
        total = weight = 0.0
        for fs in parts:
            total += sum(map(self.weight, fs))
            reach = 0
            for i, f in windows(fs):
                if f and self.contained(f, labels):
                    weight += sum(map(self.weight, fs[max(i, reach) : i + len(f)]))
                    reach = i + len(f)
        return weight >= COVERAGE * total

    def is_residue(self, part: str) -> bool:
        """Whether nearly all of a part is contained in exemplars. One word alone, and numbers alone, are no page."""
        plain = features(TAG.sub(" ", part))
        if len(plain) < 2 or not set(plain) - {"9"}:
            return False
        distinct = set(plain)
        latin = "lorem" in distinct or "ipsum" in distinct or sum(len(w) >= 6 and _LATIN.fullmatch(w) is not None for w in distinct) >= LATIN_WORDS
        if latin:
            plain = ["latinword" if _LATIN.fullmatch(w) else w for w in plain]
        labels = [k for k in self.known if self.may_be(plain, k) and (k == RESIDUE or len(plain) >= DOODLE)]
        if not labels:
            return False
        fs = [f for f in (features(p, latin) for p in passages(part)) if f]
        return any(self.covered(fs, k) for k in labels)

    def has_field(self, message: str) -> bool:
        """Whether a passage of the message still has an unfilled field: it is contained in a form, or a form stands whole in it. A quoted field is talked about."""
        if not FIELD.search(message):
            return False
        message = re.sub(r"`[^`\n]*`", " quoted ", message)
        for p in passages(FIELD.sub(" \x02 ", message)):
            for _, f in windows(features(p)) if "\x02" in p else ():
                if "\u0192field" not in f:
                    continue
                for n, x in self.containments(f).items():
                    label, ws, _ = self.exemplars[n]
                    held = sum(self.weight(w) for w in ws & set(f)) / self.whole[n]
                    if label == "form" and (x >= FORM or x >= FILLED and held >= FORM and len(ws) > 2) and x >= self.best(f, ("mention",)):
                        return True
        return False


def document_frequencies(docs: DataFrame, text: str) -> DataFrame:
    """word, df: in how many of all documents each exemplar word stands. At most one row per exemplar word."""
    known = F.array(*[F.lit(w) for w in vocabulary()])
    ws = F.array_intersect(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), known)
    return docs.select(F.explode(ws).alias("word")).groupBy("word").agg(F.count("*").alias("df"))


def residue(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, why: one row per document whose message has unfilled fields (``field``) or whose message, diff or whole text is residue (``message``, ``diff``).

    NULL and empty texts, empty messages and empty diffs are none. Equal rows are judged alike, one by one. Whole texts are read.
    """
    n = docs.count()
    df = {r["word"]: r["df"] for r in document_frequencies(docs, text).collect()}  # bounded by the exemplars' words
    weights = {w: math.log(1 + (n + 1) / (df.get(w, 0) + 1)) for w in vocabulary()}
    unseen = math.log(1 + (n + 1))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(weights, unseen)
        for b in batches:
            rows = []
            for k, t in zip(b[key], b[text]):
                message, diff = parts(t)
                message = _PICKED.sub("", message)
                why = "field" if index.has_field(message) else "message" if index.is_residue(message) else "diff" if index.is_residue(diff) else None
                if why:
                    rows.append((k, why))
            yield pd.DataFrame(rows, columns=[key, "why"])

    return docs.select(key, text).mapInPandas(judge, f"{key} {dict(docs.dtypes)[key]}, why string")


def p9_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_residue(spark, sf_dir).select("doc_id").distinct()


SQL: dict[str, str] = {}
QUERIES = {"p9_found": p9_found, "p9_residue": p9_residue}
