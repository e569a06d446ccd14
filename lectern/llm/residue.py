"""Problem 10: template residue, filler and error pages.

Three kinds of evidence. Placeholders are found by one grammar per delimiter,
after code blocks, code spans and quotations have been set aside, and weighed
against the words around them. Filler is told by the share of its small
vocabulary, messages of failing sites by the share of the text that lies in
short sentences saying so.

The patterns run in Arrow batches: the same rules as built-in expressions were
measured at eight times the CPU, for want of a cheap test of a text's words
against a set.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Placeholder grammars by delimiter (fixed values).
PLACEHOLDERS = (
    r"\{\{[^{}\n]{1,60}\}\}",
    r"\{%[^{}\n]{1,60}%\}",
    r"<%[^<>\n]{1,60}%>",
    r"[$#]\{[^{}\n]{1,60}\}",
    r"(?<![$#{])\{[A-Za-z][\w. ]{0,40}\}(?!\})",
    r"\[(?:(?i:insert|your|enter|add) )[^\]\n]{1,60}\]",
    r"\[[^\]\n]{1,60} (?:TBD|TBA|TODO|here)\]",
    r"\([^()\n]{1,60} goes here\)",
    r"<<\w[\w. ]{0,40}>>",
    r"(?<!\w)__[A-Za-z]\w{0,40}?__(?!\w)",
    r"%[A-Za-z]\w{1,40}%",
    r"@@\w{1,40}@@",
)
#: Words of the customary filler text (fixed values).
FILLER = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
).split()
#: What stands for text to come, and what sites say when they fail or demand scripts or cookies, by language (fixed values).
MESSAGES = (
    # text that stands for text to come
    r"\breplace this (?:paragraph|text|sentence)\b",
    r"\b(?:text|content|chapter|title) (?:pending|to follow|to come)\b",
    r"\bto be supplied\b",
    r"\bclick (?:here )?to (?:add|edit) (?:text|title|content)\b",
    r"\b(?:copy|text|content) goes here\b",
    r"\byour (?:own )?text here\b",
    r"^\W*(?:placeholder|sample|dummy) text\b",
    r"\b(?:texto de relleno|blindtext|platzhaltertext|faux texte|texto provisório|texto simulado)\b",
    r"\b(?:texte à venir|text folgt|texto por vir|texto pendiente)\b",
    # English
    r"\b(?:enable|turn on|activate|allow|requires?) (?:java)?scripts?\b",
    r"\bjavascript is (?:disabled|required|not)",
    r"\bneeds (?:java)?scripts? to\b",
    r"\b(?:java)?scripts? must be\b",
    r"\bcookies (?:must|are|have to)\b",
    r"\b(?:enable|accept|allow) cookies\b",
    r"\bad ?blocker\b",
    r"\byour browser\b",
    r"^\s*loading\s*(?:\.|…|$)",
    r"\bchecking your browser\b",
    r"\bverification code \d",
    r"\breference code:? \d",
    r"\bonly a few seconds\b",
    r"\breload the page\b",
    r"\bplease (?:go back|try again|contact|wait|sign in|log in)\b",
    r"\btry again later\b",
    r"\bif the problem persists\b",
    r"\byour session (?:has|is)\b",
    r"^\W*session expired",
    r"\bsign in again\b",
    r"^\W*(?:http )?[45]\d\d\b(?: \w+){0,4}\W*$",
    r"^\W*(?:http )?(?:error )?[45]\d\d (?:forbidden|not found|bad gateway|unauthorized|internal server error|service unavailable|gateway time-?out|too many requests|bad request)\b",
    r"^\W*(?:fatal )?error(?: \d+)?\W*$",
    r"\b(?:page|file|document|title|chapter) (?:was |is )?not (?:found|available)\b",
    r"\b(?:page|chapter|file|document) you (?:requested|are looking for)\b",
    r"\bserver was unable\b",
    r"\bunable to complete your request\b",
    r"\bcould not connect\b",
    r"\bconnection (?:timed out|refused|reset)\b",
    r"\btoo many requests\b",
    r"\bunexpected (?:null|error|token)\b.*\bline \d",
    r"\bdo not have permission\b",
    r"^\W*access denied",
    r"^\W*something went wrong",
    r"^\W*oops\b",
    r"^\W*menu \| ",
    r"^\W*(?:bad gateway|forbidden|not found|internal server error|service unavailable)\W*$",
    r"\btitle is not available\b",
    # German
    r"\bjavascript\b.*\b(?:aktivieren|erforderlich|deaktiviert)\b",
    r"\baktivieren sie\b.*\b(?:javascript|cookies)\b",
    r"\b(?:skripte|cookies) (?:erlaubt|sind|müssen)",
    r"\bmüssen skripte\b",
    r"^\s*wird geladen",
    r"\bladen sie die seite\b",
    r"\bkeine berechtigung\b",
    r"\bversuchen sie es\b.*\b(?:erneut|noch einmal)\b",
    r"\bangeforderte seite\b",
    r"\bseite nicht gefunden\b",
    r"\bfehler(?:code)?:? \d+",
    r"^\W*zugriff verweigert",
    r"^\W*interner serverfehler",
    r"\bsitzung\b.*\babgelaufen\b",
    # French
    r"\b(?:activer|activez) (?:le )?javascript\b",
    r"\bscripts sont nécessaires\b",
    r"\bcookies (?:doivent|sont)\b",
    r"^\s*chargement\b",
    r"\brechargez\b.*\bpage\b",
    r"\bpage demandée\b",
    r"\bpage (?:introuvable|non trouvée)\b",
    r"\bréessayer plus tard\b",
    r"\bpas le droit de\b",
    r"^\W*accès (?:refusé|interdit)",
    r"^\W*(?:code|erreur)\s*:? \d+",
    r"\berreur interne\b",
    r"\bsession\b.*\bexpiré",
    # Spanish
    r"\b(?:active|activar|habilite) javascript\b",
    r"\bnecesitan cookies\b",
    r"\bejecutar scripts\b",
    r"^\s*cargando\b",
    r"\brecargue la página\b",
    r"\bpágina (?:solicitada|no encontrada)\b",
    r"\bintentarlo más tarde\b",
    r"\bno tiene permiso\b",
    r"^\W*acceso denegado",
    r"^\W*(?:código|error):? \d+",
    r"\berror interno\b",
    r"\bsesión\b.*\b(?:caducado|expirado|terminado)\b",
    # Portuguese
    r"\b(?:ative|ativar|habilite) o? ?javascript\b",
    r"\bcookies (?:devem|são|precisam)\b",
    r"^\s*(?:carregando|a carregar)\b",
    r"\brecarregue a página\b",
    r"\bpágina (?:solicitada|pedida|não encontrada)\b",
    r"\btente (?:novamente|de novo|mais tarde)\b",
    r"\bnão tem permissão\b",
    r"^\W*acesso negado",
    r"^\W*(?:código|erro):? \d+",
    r"\berro interno\b",
    r"\bsessão\b.*\bexpir",
)
#: Words of which every message above has one, if not a status number (fixed values): what has none needs no pattern.
ANCHORS = (
    "javascript javascripts script scripts cookies blocker adblocker again browser loading verification reference seconds reload back later contact wait sign log persists session requests http error "
    "forbidden found gateway unauthorized server service available time bad unable connect connection unexpected permission denied wrong oops menu "
    "not page chapter file document title internal replace pending follow come supplied click copy here placeholder sample dummy relleno blindtext platzhaltertext faux provisório simulado venir folgt vir pendiente "
    "aktivieren erforderlich deaktiviert skripte geladen laden berechtigung versuchen angeforderte seite fehler fehlercode verweigert serverfehler sitzung "
    "activer activez chargement rechargez demandée introuvable trouvée réessayer droit accès code erreur interne expirée expiré "
    "active activar habilite cargando recargue solicitada encontrada intentarlo permiso denegado código interno sesión "
    "ative ativar carregando carregar recarregue pedida tente permissão negado erro sessão"
).split()
#: Quoted and code text, in which placeholders are a subject, not a gap.
_SET_ASIDE = re.compile(r"(?s:```.*?```)|`[^`\n]{1,200}`|(?m:^(?: {4,}|\t).*$)|[“„«\"][^“”„«»\"\n]{0,200}[”“»\"]")
_PLACEHOLDER = re.compile("|".join(PLACEHOLDERS))
_MAY_HOLD = re.compile(r"[{\[<%@_]|goes here")
_MESSAGE = re.compile("|".join(MESSAGES))
_WORD = re.compile(r"\w+")
_SYMBOL = re.compile(r"[^\w\s]")
_SENTENCE_END = re.compile(r"(?<=[.!?…])\s+|\n+")
#: A sentence of more words is no site's message.
LONGEST_MESSAGE = 30
_FILLER = frozenset(x + end for x in FILLER for end in ("", ".", ",", "!", "?", ";", ":"))
_ANCHORS = frozenset([*ANCHORS, *map(str, range(400, 600))])


class _Anchored(dict):
    """Anchors in a run of non-blanks, signs around and inside it aside; what was asked for is remembered."""

    def __missing__(self, token: str) -> int:
        if len(self) > 400_000:
            self.clear()
        n = self[token] = sum(map(_ANCHORS.__contains__, _WORD.findall(token)))
        return n


_anchored = _Anchored()


def kind_of(text: str | None, words_per_placeholder: float = 10.0, filler_share: float = 0.6, message_share: float = 0.5) -> str | None:
    """`template`, `filler`, `message` or None; see `classify`."""
    if not text or text.isspace():
        return None
    if _MAY_HOLD.search(text):
        plain = _SET_ASIDE.sub(" ", text)
        gaps = sum(1 for _ in _PLACEHOLDER.finditer(plain))
        if gaps and gaps * words_per_placeholder >= len(_WORD.findall(plain)) and len(_SYMBOL.findall(text)) <= 0.4 * len(text):
            return "template"
    lower = text.lower()
    words = lower.split()
    if sum(map(_FILLER.__contains__, words)) >= filler_share * len(words):
        return "filler"
    # A message has an anchor in at most LONGEST_MESSAGE words, so fewer anchors than this rule the share out.
    if sum(map(_anchored.__getitem__, words)) < message_share * len(words) / LONGEST_MESSAGE:
        return None
    sentences = [(x, x.split()) for x in _SENTENCE_END.split(_SET_ASIDE.sub(" ", lower))]  # a quoted message is a subject
    least = message_share * len(lower)
    may = [x for x, parts in sentences if len(parts) <= LONGEST_MESSAGE and any(map(_anchored.__getitem__, parts))]
    if not may or sum(map(len, may)) < least:
        return None
    return "message" if sum(len(x) for x in may if _MESSAGE.search(x)) >= least else None


def classify(documents: DataFrame, text: str = "text", words_per_placeholder: float = 10.0, filler_share: float = 0.6, message_share: float = 0.5) -> DataFrame:
    """Add `residue`: template, filler or message for texts that consist of such, else null.

    A text is a template if it has a placeholder for every `words_per_placeholder`
    words outside code and quotations; prose that mentions a few, or shows them
    in code, is none; nor is a string of symbols in which one happens to turn up.
    Null, empty and blank texts are none. A column already called `residue` is
    replaced. Narrow: no shuffle.
    """
    keep = [c for c in documents.columns if c != "residue"]
    schema = documents.select(*keep).withColumn("residue", F.lit(None).cast("string")).schema
    at = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = map(kind_of, batch.column(at).to_pylist(), repeat(words_per_placeholder), repeat(filler_share), repeat(message_share))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(kinds), pa.string())], names=[*keep, "residue"])

    return documents.select(*keep).mapInArrow(run, schema)


def residue(documents: DataFrame) -> DataFrame:
    """`doc_id, residue` of the documents that are leftovers, once each."""
    return classify(documents.select("doc_id", "text")).where(F.col("residue").isNotNull()).select("doc_id", "residue").distinct()


def without_residue(documents: DataFrame) -> DataFrame:
    """The documents that are content; all columns and rows as they came, null and blank texts included."""
    return classify(documents).where(F.col("residue").isNull()).drop("residue")
