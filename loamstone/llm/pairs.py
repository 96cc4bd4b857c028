"""Broken question-answer pairs, by tagging the clauses of an answer with a conditional random field.

Each clause of a response is tagged answer, refusal, echo, foreign, unfinished or extra (lead-ins, courtesy, contact lines);
a pair's defect follows from how much of the response each tag covers.

The tables hold no labels, so the field learns from constructed pairs: answers of a bounded sample of the pairs
(``TRAIN_ROWS``, least hash of the key first) are cut inside a clause, given to a question in another language, preceded or
replaced by the question itself in changed form, or replaced by refusals composed from a small grammar. What the field sees is
none of these rules: hashed words and word pairs (words of the question made equal), signs and kinds of
words at a clause's end, place and length, shares of words in common with the question, and the languages of both.
Extras are labelled by how the sample uses them: openings that recur before different answers, and clauses as much at home in
questions as in answers.

Everything is computed for whole batches in arrays; Python runs once a token only to look it up.

Defined results: a NULL, blank or stand-in response is ``empty`` whatever the question; a NULL or empty question
leaves echo and language undecided; repeated rows of a key count once; a pair has one defect at most, in
the order empty, refusal, echo, wrong_language, truncated.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstone.llm.lookup import portions
from loamstone.plans.tables import spread

TRAIN_ROWS = 4000
#: Constructed pairs the field is trained on.
EXAMPLES = 16_000
TAGS = ("answer", "refusal", "echo", "foreign", "unfinished", "extra")
_A, _R, _E, _F, _U, _X = range(6)
_K = len(TAGS)
#: Hashed features of words and word pairs, and room for all others behind them.
_WORDS, _OTHERS = 1 << 18, 4096

# Frequent words that tell languages apart.
_FUNCTION_WORDS = {
    "en": "the of and to in is that for it with as on at by this from or an be are was were not if you your which what who how why does do can may must will has have between after before each only while when than then they there their its our my so please near should again",
    "de": "der die das und ist in den von zu mit dem für auf ein eine nicht auch als an wird werden muss sie ihr wenn wie was warum wo welche über bei nach vor unter bis oder aber noch so sich im vom zum zur dann nur kann darf ich es dass sonst erst davon beim alle jede mir",
    "fr": "le la les de des du et est en un une que qui dans pour pas sur au aux avec par ce cette ne se sont plus ou où il elle nous vous je mais si puis tant avant après quel quelle comment pourquoi faut entre sans toutes encore qu",
    "es": "el la los las de del y es en un una que para no con por se su al lo como más o pero si entre cuando antes después cada qué cuál cómo dónde cuánto según hasta sobre sin mientras aunque usted este esta",
    "pt": "o os as da do das dos e em um uma não com para por mais como ao pelo pela são é antes após se",
    "it": "il lo gli di che e è in un una per con non si del della dei delle alla sono come più",
    "ru": "и в не на что с по для при из от это как только после если мы вы номер",
}
_LANGS = list(_FUNCTION_WORDS)
_LETTERS = {"de": "äöüß", "fr": "çèêîôûœàâëï", "es": "ñ¿¡íóú", "ru": "абвгдежзийклмнопрстуфхцчшщъыьэюя"}
# Names of languages, by which a question asks for one.
_ASKED = {
    "en": r"english|anglais|inglés|englisch\w*|inglese|английск\w*", "de": r"german|deutsch\w*|allemand|alemán|tedesco|немецк\w*",
    "fr": r"french|français|französisch\w*|francés|francese|французск\w*", "es": r"spanish|español|spanisch\w*|espagnol|castellano|spagnolo|испанск\w*",
    "it": r"italian|italiano|italienisch\w*|italien", "pt": r"portuguese|português|portugiesisch\w*|portugais|portugués",
}
_ASKS = [(_LANGS.index(k), re.compile(rf"(?i)(?:{v})")) for k, v in _ASKED.items()]
# What stands for an answer that is not there.
_STANDINS = {"n a", "na", "tbd", "null", "none", "nil", "nan", "undefined", "empty", "no response", "no answer", "no reply", "no output", "no content", "answer", "assistant", "response", "reply", "output", "todo", "to be done", "leer", "keine antwort", "antwort", "sin respuesta", "respuesta", "vacío", "pas de réponse", "réponse", "vide", "placeholder", "pending", "blank", "ai", "bot", "a", "error"}
_WORD = re.compile(r"[^\W_]+")
_MARKUP = re.compile(r"<[^<>]{0,40}>|[`*_#>|~]+|&nbsp;")


def is_standin(text: str | None) -> bool:
    if text is None:
        return True
    if len(text) > 200 and not text.isspace() and _WORD.search(text, 0, 50):
        text = text[:200] if len(_WORD.findall(text[:200])) > 5 else text  # more words than any stand-in has
    t = _MARKUP.sub(" ", unicodedata.normalize("NFKC", text))
    w = _WORD.findall(t.lower())
    return not w or " ".join(w) in _STANDINS


# ---- constructed defects -------------------------------------------------------------------------------

# A grammar of refusals by language; {t} is a topic of the question.
_REFUSALS = {
    "en": (
        ("", "", "", "Sorry, ", "I’m sorry, but ", "I am sorry, ", "Unfortunately, ", "Unfortunately ", "I apologise, but ", "Regrettably, ", "As an assistant, ", "As an AI model, ", "Thanks for asking, but ", "Thank you for asking; however, ", "Thank you, but ", "Apologies, but ", "Apologies – ", "My apologies: "),
        ("I can’t help with {t}.", "I cannot assist with {t}.", "I am unable to answer questions about {t}.", "I’m not able to help with {t}.", "I won’t be able to assist with {t}.", "I can’t comment on {t}.", "I cannot discuss {t}.", "I can’t provide {t}.", "I cannot share information on {t}.", "I must decline {t}.", "I have to decline this request.", "I would rather not answer {t}.", "I’d rather not go into {t}.", "I am not allowed to talk about {t}.", "I’m not permitted to answer {t}.", "I am not authorised to speak about {t}.", "I don’t feel comfortable going into {t}.", "I’m not comfortable discussing {t}.", "no comment on {t} is possible from my side.", "{t} is something I can’t help with.", "this is something I won’t be able to answer.", "that falls outside what I may discuss.", "{t} is outside what I can talk about.", "providing this would not be appropriate.", "answering {t} would not be appropriate.", "it would not be appropriate to answer {t}.", "{t} is off limits for me.", "this goes against my guidelines.", "I cannot comply, as {t} goes against my guidelines.", "I’d rather not respond to this one.", "I am not able to answer questions about {t}.", "this is something I won’t be able to assist with.", "I cannot fulfil {t}.", "my policy does not allow me to answer {t}.", "I refuse to answer {t}.", "I prefer not to respond to {t}.", "I have nothing to say about {t}.", "there is no answer I can give on {t}.", "I am in no position to say anything about {t}."),
        ("this", "that", "your question", "this topic", "such requests", "this request", "the matter"),
        ("", "", "", "Please ask someone else.", "I hope you understand.", "Is there anything else you need?", "You may want to contact a specialist.", "Thank you for understanding.", "Please turn to an expert."),
    ),
    "de": (
        ("", "", "", "Leider ", "Leider: ", "Es tut mir leid, ", "Tut mir leid, ", "Entschuldigung, ", "Als Assistent: ", "Bedaure, "),
        ("dabei kann ich nicht helfen.", "dabei kann ich Ihnen leider nicht helfen.", "ich kann zu {t} nichts sagen.", "ich kann {t} nicht beantworten.", "das möchte ich lieber nicht beantworten.", "dazu darf ich keine Auskunft geben.", "dazu kann ich mich nicht äußern.", "ich darf über {t} nicht sprechen.", "ich bin nicht befugt, über {t} zu sprechen.", "ich bin nicht berechtigt, {t} zu erläutern.", "diese Anfrage muss ich ablehnen.", "ich muss {t} ablehnen.", "es ist mir nicht gestattet, {t} zu besprechen.", "das liegt außerhalb dessen, was ich besprechen darf.", "zu {t} gebe ich keine Antwort.", "eine Antwort zu {t} ist mir nicht möglich.", "das wäre nicht angemessen.", "ich fühle mich nicht wohl dabei, über {t} zu reden.", "ich möchte {t} nicht kommentieren.", "kein Kommentar zu {t} von meiner Seite.", "ich verweigere die Antwort auf {t}.", "hierbei kann ich nicht weiterhelfen."),
        ("dieses Thema", "diese Frage", "diese Anfrage", "so etwas", "diesen Punkt"),
        ("", "", "", "Bitte fragen Sie jemand anderen.", "Ich bitte um Verständnis.", "Wenden Sie sich an eine Fachkraft.", "Kann ich sonst helfen?", "Danke für Ihr Verständnis."),
    ),
    "fr": (
        ("", "", "", "Désolé, ", "Désolée, ", "Je suis désolé, mais ", "Malheureusement, ", "Je regrette, ", "En tant qu’assistant, "),
        ("je ne peux pas vous aider sur ce point.", "je ne peux pas répondre à {t}.", "je ne puis répondre à {t}.", "je ne suis pas en mesure d’aborder {t}.", "je ne suis pas autorisé à parler de {t}.", "je préfère ne pas répondre.", "je préférerais ne pas commenter {t}.", "je dois refuser {t}.", "je dois décliner cette demande.", "il ne m’est pas permis de répondre à {t}.", "cela sort de ce que je peux aborder.", "aucun commentaire sur {t} n’est possible de ma part.", "je ne souhaite pas parler de {t}.", "je n’ai pas le droit de donner {t}.", "répondre à {t} ne serait pas approprié.", "je ne suis pas à l’aise pour parler de {t}.", "je refuse de répondre à {t}.", "il m’est impossible de répondre à {t}."),
        ("ce sujet", "cette question", "cette demande", "ce genre de chose"),
        ("", "", "", "Merci de votre compréhension.", "Demandez à quelqu’un d’autre.", "Adressez-vous à un spécialiste.", "Puis-je faire autre chose pour vous ?"),
    ),
    "es": (
        ("", "", "", "Lo siento, ", "Lo siento, pero ", "Lamentablemente, ", "Por desgracia, ", "Perdone, ", "Como asistente, "),
        ("no puedo ayudar con {t}.", "no puedo responder a {t}.", "no puedo ayudarle con eso.", "no puedo hablar de {t}.", "no puedo dar información sobre {t}.", "no puedo comentar {t}.", "prefiero no responder.", "prefiero no hablar de {t}.", "debo rechazar {t}.", "tengo que rechazar esta solicitud.", "no me está permitido hablar de {t}.", "no me es posible responder a {t}.", "no estoy autorizado a tratar {t}.", "eso queda fuera de lo que puedo tratar.", "no sería apropiado responder a {t}.", "ningún comentario sobre {t} es posible por mi parte.", "no me siento cómodo al hablar de {t}.", "me niego a responder a {t}.", "no estoy en condiciones de opinar sobre {t}."),
        ("este tema", "esta pregunta", "esta solicitud", "eso"),
        ("", "", "", "Consulte a otra persona.", "Gracias por su comprensión.", "Acuda a un especialista.", "¿Puedo ayudarle en algo más?"),
    ),
}
# How an echo is led in, and how a language is asked for.
_LED_IN = {
    "en": ("You asked:", "Your question was:", "Let me repeat:", "Sure!", "So:", "The question is:", "To repeat:", "Of course!"), "de": ("Sie fragen:", "Ihre Frage:", "Ihre Frage war:", "Gerne!", "Also:", "Zur Frage:", "Sie möchten wissen:"),
    "fr": ("Vous demandez :", "Votre question :", "Votre question était :", "Bien sûr !", "Alors :", "Je répète :"), "es": ("Usted pregunta:", "Su pregunta:", "Su pregunta era:", "¡Claro!", "Entonces:", "Repito:"),
}
_ASKING = {
    "en": ("Please answer in English.", "Bitte auf Englisch antworten.", "Répondez en anglais, s’il vous plaît.", "Responda en inglés, por favor."), "de": ("Please answer in German.", "Bitte auf Deutsch.", "Répondez en allemand.", "Responda en alemán, por favor."),
    "fr": ("Please answer in French.", "Bitte auf Französisch antworten.", "En français, s’il vous plaît.", "Responda en francés, por favor."), "es": ("Please answer in Spanish.", "Bitte auf Spanisch antworten.", "Répondez en espagnol.", "Responda en español, por favor."),
}

# ---- tokens --------------------------------------------------------------------------------------------

#: A sign that ends a clause is a token with the blank after it.
_TOKEN = re.compile(r"\n|```|[.!?…:]+[\"”’»)\]*`]*[^\S\n]|\d+(?:[.,:/]\d+)*(?![^\W_])|[^\W_]+|[^\w\s]|_")
_LOWER, _CAP, _UPPER, _NUMBER, _LINE, _FENCE, _STOP, _COLON, _DOTS, _OPEN, _CLOSE, _QUOTE, _QUOTED, _MARK, _AT, _COMMA, _OTHER = range(17)
_CLASS = {"\n": _LINE, "```": _FENCE, "(": _OPEN, "[": _OPEN, "{": _OPEN, ")": _CLOSE, "]": _CLOSE, "}": _CLOSE, "“": _QUOTE, "«": _QUOTE, "„": _QUOTE, "”": _QUOTED, "»": _QUOTED, '"': _MARK, "@": _AT, ",": _COMMA, ";": _COMMA, "…": _DOTS}


class _Ids(dict):
    def __missing__(self, k):
        n = self[k] = len(self)
        return n


class Tokens:
    """Numbers for tokens, and what is known of each."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.ids, self.lows = _Ids(), _Ids()
        self.kind, self.ends, self.short, self.low, self.hash, self.tongue = np.zeros(0, np.int8), np.zeros(0, bool), np.zeros(0, bool), np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros((0, len(_LANGS)), np.float32)
        self.content = np.zeros(0, bool)
        #: Languages that a word names, by its number in lower case.
        self.named: dict[int, list[int]] = {}

    def read(self, texts: list[str | None]) -> list[list[int]]:
        ids = self.ids
        return [[ids[x] for x in _TOKEN.findall(t)] if t else [] for t in texts]

    def know(self) -> None:
        """Attributes of all tokens met since the last call."""
        new = list(self.ids)[len(self.kind) :]
        if not new:
            return
        kind, ends, short, low, content, names = [], [], [], [], [], []
        tongue = np.zeros((len(new), len(_LANGS)), np.float32)
        for i, x in enumerate(new):
            c = x[0]
            s = x.rstrip()
            if c.isalnum():
                k = _NUMBER if any(y.isdigit() for y in x) else _UPPER if len(x) > 1 and x.isupper() else _CAP if c.isupper() else _LOWER
            else:
                k = _LINE if c == "\n" else _CLASS.get(s) or (_DOTS if "…" in s or s.startswith("..") else _COLON if s[:1] == ":" else _STOP if s[:1] in ".!?" else _OTHER)
            kind.append(k)
            ends.append(len(x) > len(s) > 0)
            short.append(k in (_CAP, _UPPER) and len(x) <= 4 or k in (_LOWER, _NUMBER) and len(x) == 1)
            y = x.strip().lower()
            low.append(self.lows[y])
            if k <= _UPPER and len(y) > 4 and (js := [j for j, p in _ASKS if p.fullmatch(y)]):
                self.named[low[-1]] = js
            names.append(re.sub(r"\d", "0", y))
            said = [j for j, ws in enumerate(_FUNCTIONS) if y in ws]
            if said:
                tongue[i, said] = 1.0 / len(said)
            elif k == _LOWER or k == _CAP:
                for j, letters in _TELLING:
                    tongue[i, j] = 0.4 * min(2, sum(ch in letters for ch in y))
            content.append(k <= _NUMBER and not said and (len(y) > 2 or k == _NUMBER))
        self.kind = np.r_[self.kind, np.array(kind, np.int8)]
        self.ends, self.short, self.content = np.r_[self.ends, np.array(ends, bool)], np.r_[self.short, np.array(short, bool)], np.r_[self.content, np.array(content, bool)]
        self.low = np.r_[self.low, np.array(low, np.int32)]
        self.hash = np.r_[self.hash, pd.util.hash_array(np.array(names, dtype=object))]
        self.tongue = np.concatenate([self.tongue, tongue])


_FUNCTIONS = [set(ws.split()) for ws in _FUNCTION_WORDS.values()]
_TELLING = [(_LANGS.index(k), set(v)) for k, v in _LETTERS.items()]


def _language(score: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """The likeliest language by its score, -1 where nothing tells."""
    if not len(score):
        return np.zeros(0, np.int8)
    best = score.argmax(axis=1)
    top = score.max(axis=1)
    rest = np.partition(score, -2, axis=1)[:, -2]
    return np.where((top >= 1) & (top > 1.25 * rest) & (n_words >= 3), best, -1).astype(np.int8)


def _cumulative(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros((1, *x.shape[1:]), x.dtype), np.cumsum(x, axis=0, dtype=x.dtype)])


class Clauses:
    """The clauses of some responses with their features: hashed words (``words``, ``word_off``) and the others (``marks``)."""

    def __init__(self, tokens: Tokens, queries: list[list[int]], responses: list[list[int]]):
        tokens.know()
        size = np.array([len(r) for r in responses], np.int64)
        tok = np.fromiter((x for r in responses for x in r), np.int64, int(size.sum()))
        text = np.repeat(np.arange(len(size)), size)
        kind, n = tokens.kind[tok], len(tok)
        first, last = np.zeros(n, bool), np.zeros(n, bool)
        at = np.cumsum(size) - size
        first[at[size > 0]], last[(at + size - 1)[size > 0]] = True, True
        # a fenced block is one clause
        fence = np.cumsum(kind == _FENCE)
        fence = (fence - np.r_[0, fence][at][text]) % 2 == 1 if n else np.zeros(0, bool)
        line = kind == _LINE
        begins = np.r_[True, (line | first[np.minimum(np.arange(n) + 1, n - 1)])[:-1]] if n else first  # a line or text begins here
        before = np.r_[0, np.arange(n - 1)] if n else np.zeros(0, int)
        number = (kind[before] == _NUMBER) & begins[before]  # of a list
        stops = tokens.ends[tok] & ~number & ~((kind == _STOP) & tokens.short[tok[before]])
        cut = (line | stops) & ~fence | last | (kind == _FENCE) & ~fence
        clause = np.r_[0, np.cumsum(cut)[:-1]] if n else np.zeros(0, int)
        # without clauses of nothing but line breaks
        solid = np.bincount(clause, weights=~line, minlength=int(clause[-1]) + 1 if n else 0) > 0
        keep = solid[clause] if n else np.zeros(0, bool)
        tok, text, kind, clause, fence = tok[keep], text[keep], kind[keep], (np.cumsum(solid) - 1)[clause[keep]], fence[keep]
        n, m = len(tok), int(solid.sum())
        self.n = m
        begin = np.searchsorted(clause, np.arange(m))
        end = np.r_[begin[1:], n]
        self.text = text[begin] if m else np.zeros(0, int)
        self.first_token, self.token_clause, self.tok = begin, clause, tok
        self.begin = np.searchsorted(self.text, np.arange(len(size)))
        self.count = np.bincount(self.text, minlength=len(size))
        which = np.arange(m) - self.begin[self.text]
        of = self.count[self.text]
        is_last, is_first = which == of - 1, which == 0
        per = lambda x: np.add.reduceat(x, begin) if m else np.zeros(0)
        is_word = kind <= _NUMBER
        self.words_n = per(is_word.astype(np.int64)).astype(np.int64)

        # questions: their words and languages, whole and of the parts that ask
        q_size = np.array([len(q) for q in queries], np.int64)
        q_tok = np.fromiter((x for q in queries for x in q), np.int64, int(q_size.sum()))
        q_text = np.repeat(np.arange(len(q_size)), q_size)
        width = np.int64(len(tokens.lows) + 1)
        content = tokens.content
        q_keys = np.unique(q_text[content[q_tok]] * width + tokens.low[q_tok[content[q_tok]]])
        q_words = np.bincount(q_keys // width, minlength=len(q_size))
        q_score = np.zeros((len(q_size), len(_LANGS)), np.float32)
        np.add.at(q_score, q_text, tokens.tongue[q_tok])
        self.query_language = _language(q_score, np.bincount(q_text, weights=tokens.kind[q_tok] <= _UPPER, minlength=len(q_size)))
        # words in common
        keys = text * width + tokens.low[tok]
        common = np.zeros(n, bool)
        rows = np.flatnonzero(content[tok])
        if len(q_keys):
            at = np.minimum(np.searchsorted(q_keys, keys[rows]), len(q_keys) - 1)
            common[rows] = q_keys[at] == keys[rows]
        n_content, n_common = per(content[tok].astype(np.int64)), per(common.astype(np.int64))
        here = n_common / np.maximum(n_content, 1)
        pairs_of = np.unique(clause[common] * np.int64(1 << 32) + tokens.low[tok[common]])
        there = np.bincount(pairs_of >> 32, minlength=m) / np.maximum(q_words[self.text], 1) if m else np.zeros(0)
        given = (here >= 0.75) & (n_content > 0)
        back = np.bincount(self.text, weights=np.where(given, there, 0), minlength=len(size)) if m else np.zeros(len(size))
        # languages, without what is quoted
        quote = _cumulative((kind == _QUOTE).astype(np.int32) - (kind == _QUOTED))
        mark = _cumulative((kind == _MARK).astype(np.int32))
        inside = ((quote[:-1] - quote[begin][clause]) > 0) | ((mark[:-1] - mark[begin][clause]) % 2 == 1) if m else np.zeros(0, bool)
        own = per((~inside & is_word & (kind != _NUMBER)).astype(np.int64))
        told = np.where((inside | fence)[:, None], 0, tokens.tongue[tok])
        self.language = _language(np.add.reduceat(told, begin) if m else np.zeros((0, len(_LANGS))), own)
        asked = np.zeros((len(q_size), len(_LANGS)), bool)
        for i in np.flatnonzero(np.isin(tokens.low[q_tok], np.array(list(tokens.named), np.int64))):
            asked[q_text[i], tokens.named[int(tokens.low[q_tok[i]])]] = True
        ql = self.query_language[self.text]
        is_asked = (self.language >= 0) & asked[self.text, self.language]
        relation = np.where(self.language < 0, 0, np.where(is_asked, 1, np.where(ql < 0, 2, np.where(ql == self.language, 3, 4))))
        self.asked, self.relation = is_asked, relation

        # features: of every word and pair of words, where content words of the question are all the same
        h = np.where(common & (kind != _NUMBER), np.uint64(0x51), tokens.hash[tok])
        h = np.where(fence & (kind != _FENCE), np.uint64(0x77), h)  # words of code tell nothing
        with np.errstate(over="ignore"):
            pair = (np.r_[np.uint64(7), h[:-1]] * np.uint64(0x9E3779B97F4A7C15)) ^ (h * np.uint64(0xBF58476D1CE4E5B9))
        head = np.zeros(n, bool)
        head[begin] = True
        pair = np.where(head, h * np.uint64(3) + np.uint64(1), pair)
        both = np.stack([h >> np.uint64(9), pair >> np.uint64(11)], axis=1) % np.uint64(_WORDS)
        self.words = both.reshape(-1).astype(np.int64)
        self.word_off = 2 * begin
        self.word_len = 2 * (end - begin)
        # the others: one of each group
        tail = kind[end - 1] if m else np.zeros(0, np.int64)
        # line breaks that end a clause don't count
        bare = np.where((tail == _LINE) & (end - begin > 1), end - 2, end - 1)
        tail, tail2 = (kind[bare].astype(np.int64), np.where(bare > begin, kind[np.maximum(bare - 1, 0)], 17).astype(np.int64)) if m else (tail, tail)
        lead = kind[begin].astype(np.int64) if m else tail
        depth = per((kind == _OPEN).astype(np.int64) - (kind == _CLOSE))
        fences = per((kind == _FENCE).astype(np.int64))
        digits, ats = per((kind == _NUMBER).astype(np.int64)), per((kind == _AT).astype(np.int64))
        caps = per(((kind == _CAP) | (kind == _UPPER)).astype(np.int64))
        lowers = per((kind == _LOWER).astype(np.int64))
        length = np.minimum(np.log2(self.words_n + 1).astype(np.int64), 7)
        place = is_first * 2 + is_last
        odd = np.where(fences % 2 == 1, 3, np.where(depth > 0, 2, np.where(fences > 0, 1, 0)))
        groups = [
            (place, 4), (np.minimum(of, 6), 7), (length, 8), (np.where(is_last, 1 + tail, 0), 18), (np.where(is_last, 1 + tail2, 0), 19), (tail * 2 + is_last, 34), (odd * 2 + is_last, 8), (lead, 17),
            ((here * 7.99).astype(np.int64), 8), ((np.minimum(there, 1) * 7.99).astype(np.int64), 8), (given * (1 + (np.minimum(back[self.text] if m else back[:0], 1) * 5.99).astype(np.int64)), 7),
            (given * 4 + (np.minimum(there, 1) * 3.99).astype(np.int64), 8), (relation, 5), (relation * 8 + length, 40), (np.minimum(digits, 3) * 2 + (ats > 0), 8), ((lowers == 0) * 4 + np.minimum(caps, 3), 8),
            (np.where(is_last, np.where(tail <= _NUMBER, 1 + length * 4 + (tail == _NUMBER) * 2 + (lowers == 0), 33), 0), 34), ((self.words_n <= 8) * 2 + (digits > 0), 4),
            (np.where(is_last & (of == 1), 1 + np.minimum(length, 3) * 17 + tail, 0), 72),
        ]
        base, marks = _WORDS, []
        for x, width_ in groups:
            marks.append(base + x.astype(np.int64))
            base += width_
        assert base <= _WORDS + _OTHERS
        self.marks = np.stack(marks, axis=1)


# ---- the field -----------------------------------------------------------------------------------------


class Field:
    """A linear-chain conditional random field over clause tags."""

    def __init__(self, emit: np.ndarray, step: np.ndarray):
        self.emit, self.step = emit, step

    def scores(self, c: Clauses) -> np.ndarray:
        if not c.n:
            return np.zeros((0, _K), np.float32)
        return np.add.reduceat(self.emit[c.words], c.word_off) / np.sqrt(c.word_len)[:, None].astype(np.float32) + self.emit[c.marks].sum(axis=1)

    def tag(self, c: Clauses) -> np.ndarray:
        """The best sequence of tags of every text, all texts at once."""
        s = self.scores(c)
        out = np.zeros(c.n, np.int64)
        order = np.argsort(-c.count, kind="stable")
        many, begin = c.count[order], c.begin[order]
        longest = int(many[0]) if len(many) else 0
        active = [int(np.searchsorted(-many, -t, "left")) for t in range(longest)]  # texts with more than t clauses
        if not longest:
            return out
        best, back = s[begin[: active[0]]], []
        for t in range(1, longest):
            v = best[: active[t], :, None] + self.step
            back.append(v.argmax(axis=1).astype(np.int8))
            best = np.concatenate([v.max(axis=1) + s[begin[: active[t]] + t], best[active[t] :]])
        now = best.argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            out[begin[: active[t]] + t] = now[: active[t]]
            if t:
                now[: active[t]] = back[t - 1][np.arange(active[t]), now[: active[t]]]
        return out


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return np.log(np.exp(a - m).sum(axis=axis)) + m.squeeze(axis)


def train(c: Clauses, gold: np.ndarray, rounds: int = 8, rate: float = 0.4, batch: int = 48, seed: int = 5) -> Field:
    """Maximum likelihood by stochastic gradients over batches; likelihoods by the forward-backward recursion."""
    emit, step = np.zeros((_WORDS + _OTHERS, _K), np.float32), np.zeros((_K, _K), np.float32)
    field = Field(emit, step)
    squares, step_squares = np.full((_WORDS + _OTHERS, 1), 1e-3, np.float32), 1e-3
    squares[:_WORDS] = 1.0
    rng = np.random.default_rng(seed)
    texts = np.flatnonzero(c.count)
    for _ in range(rounds):
        # texts of like length together
        order = texts[np.argsort(c.count[texts] + rng.random(len(texts)), kind="stable")]
        lots = [order[i : i + batch] for i in range(0, len(order), batch)]
        for k in rng.permutation(len(lots)):
            lot = lots[k][np.argsort(-c.count[lots[k]], kind="stable")]
            size, t_max = c.count[lot], int(c.count[lot[0]])
            rows = np.full((len(lot), t_max), -1)
            for i, t in enumerate(lot):
                rows[i, : size[i]] = np.arange(c.begin[t], c.begin[t] + size[i])
            flat = rows[rows >= 0]
            where = np.concatenate([np.arange(c.word_off[r], c.word_off[r] + c.word_len[r]) for r in flat])
            words, lens = c.words[where], c.word_len[flat]
            off = np.cumsum(lens) - lens
            scale = (1 / np.sqrt(lens))[:, None].astype(np.float32)
            s_flat = np.add.reduceat(emit[words], off) * scale + emit[c.marks[flat]].sum(axis=1)
            s = np.zeros((len(lot), t_max, _K), np.float32)
            s[rows >= 0] = s_flat
            live = rows >= 0
            fw, bw = s.copy(), np.zeros_like(s)
            for t in range(1, t_max):
                fw[:, t] = np.where(live[:, t, None], _lse(fw[:, t - 1, :, None] + step, 1) + s[:, t], fw[:, t - 1])
            z = _lse(fw[:, -1], 1)
            for t in range(t_max - 2, -1, -1):
                bw[:, t] = np.where(live[:, t + 1, None], _lse(step[None] + (s[:, t + 1] + bw[:, t + 1])[:, None, :], 2), 0)
            g = -np.exp(np.minimum(fw + bw - z[:, None, None], 0))
            y = np.where(live, gold[np.maximum(rows, 0)], 0)
            g[np.arange(len(lot))[:, None], np.arange(t_max)[None], y] += 1
            g_flat = g[live]
            if t_max > 1:
                joint = np.exp(np.minimum(fw[:, :-1, :, None] + step + (s + bw)[:, 1:, None, :] - z[:, None, None, None], 0)) * live[:, 1:, None, None]
                gs = -joint.sum(axis=(0, 1))
                np.add.at(gs, (y[:, :-1][live[:, 1:]], y[:, 1:][live[:, 1:]]), 1)
                step_squares += float((gs**2).mean())
                step += rate * gs / np.sqrt(step_squares)
            index = np.concatenate([words, c.marks[flat].reshape(-1)])
            value = np.concatenate([np.repeat(g_flat * scale, lens, axis=0), np.repeat(g_flat, c.marks.shape[1], axis=0)])
            at, inv = np.unique(index, return_inverse=True)
            total = np.stack([np.bincount(inv, weights=value[:, j], minlength=len(at)) for j in range(_K)], axis=1).astype(np.float32)
            squares[at, 0] += (total**2).sum(axis=1)
            emit[at] += rate * total / np.sqrt(squares[at]) - 2e-4 * emit[at]
    return field


def _labels_of_use(c: Clauses, tokens: Tokens, queries: Clauses) -> np.ndarray:
    """Which clauses are extras, by how the sample uses them."""

    def prints(x: Clauses) -> np.ndarray:
        h = tokens.hash[x.tok]
        with np.errstate(over="ignore"):
            return np.add.reduceat(h * (np.arange(len(h), dtype=np.uint64) - x.first_token[x.token_clause].astype(np.uint64) + np.uint64(3)), x.first_token) if x.n else np.zeros(0, np.uint64)

    extra = np.zeros(c.n, bool)
    if not c.n:
        return extra
    # short openings or closings that recur beside different clauses
    p = prints(c)
    beside = np.where(np.arange(c.n) == c.begin[c.text], np.r_[p[1:], np.uint64(0)], np.r_[np.uint64(0), p[:-1]])
    short = (c.words_n <= 8) & (c.count[c.text] > 1) & (tokens.kind[c.tok[c.first_token]] != _FENCE)
    uses = pd.DataFrame({"p": p[short], "b": beside[short]}).groupby("p")["b"].agg(["count", "nunique"])
    usual = uses.index[(uses["nunique"] >= 4) & (uses["nunique"] >= 0.5 * uses["count"])].to_numpy()
    extra |= short & np.isin(p, usual)
    # identifiers: at signs, long numbers
    digits = np.array([sum(ch.isdigit() for ch in x) for x in tokens.ids], np.int64)[c.tok]
    kind = tokens.kind[c.tok]
    numeral = (digits > 0) | (kind == _OPEN) | (kind == _CLOSE) | (kind == _OTHER)
    run = np.cumsum(np.r_[True, ~numeral[1:] | ~numeral[:-1] | (c.token_clause[1:] != c.token_clause[:-1])]) - 1
    extra |= (np.maximum.reduceat(np.bincount(run, weights=digits)[run], c.first_token) >= 7) | (np.add.reduceat((kind == _AT).astype(np.int64), c.first_token) > 0)

    # as much at home in questions as in answers
    def couples(x: Clauses) -> tuple[np.ndarray, np.ndarray]:
        k = tokens.kind[x.tok]
        rows = np.flatnonzero((k[1:] == _LOWER) & (k[:-1] <= _COLON) & (x.token_clause[1:] == x.token_clause[:-1]))
        h = tokens.hash[x.tok]
        with np.errstate(over="ignore"):
            return x.token_clause[rows + 1], h[rows] * np.uint64(0x9E3779B97F4A7C15) ^ h[rows + 1]

    ac, ah = couples(c)
    qc, qh = couples(queries)
    a_n, q_n = Counter(ah.tolist()), Counter(qh.tolist())
    a = np.array([a_n[x] for x in ah.tolist()], float) / max(1, c.n)
    q = np.array([q_n.get(x, 0) for x in ah.tolist()], float) / max(1, queries.n)
    even = (q > 0) & (q > a / 2.5) & (q < 4 * a)
    n = np.bincount(ac, minlength=c.n)
    extra |= (n >= 1) & (np.bincount(ac, weights=even, minlength=c.n) >= 0.75 * np.maximum(n, 1)) & (c.words_n <= 16)
    # lines of names beside these
    bare = np.add.reduceat((kind == _LOWER).astype(np.int64), c.first_token) == 0
    bare &= (c.words_n <= 5) & (np.add.reduceat(((kind == _CAP) | (kind == _UPPER)).astype(np.int64), c.first_token) >= 1)
    same = np.r_[c.text[1:] == c.text[:-1], False]
    extra |= bare & (np.r_[extra[1:], False] & same | np.r_[False, (extra & same)[:-1]])
    return extra


class Maker:
    """Pairs with known tags, made of sampled ones."""

    def __init__(self, rows: list[tuple[str | None, str]], tokens: Tokens, seed: int = 3):
        self.tokens, self.rng = tokens, random.Random(seed)
        self.q, self.r = tokens.read([q for q, _ in rows]), tokens.read([r for _, r in rows])
        c = Clauses(tokens, self.q, self.r)
        asked = Clauses(tokens, [[] for _ in self.q], self.q)
        extra = _labels_of_use(c, tokens, asked)
        self.parts: list[list[tuple[list[int], int]]] = [[] for _ in rows]
        off = np.r_[c.first_token, len(c.tok)]
        for i in range(c.n):
            self.parts[int(c.text[i])].append((c.tok[off[i] : off[i + 1]].tolist(), _X if extra[i] else _A))
        words = np.bincount(c.text, weights=c.words_n * ~extra, minlength=len(rows)) if c.n else np.zeros(len(rows))
        echo = np.bincount(c.text, weights=c.marks[:, 11] >= _WORDS + sum((4, 7, 8, 18, 19, 34, 8, 17, 8, 8, 7)) + 6, minlength=len(rows)) if c.n else words
        # long answers are rarely refusals or echoes, those in the question's language rarely foreign
        spoken = np.zeros((len(rows), len(_LANGS)))
        np.add.at(spoken, (c.text[c.language >= 0], c.language[c.language >= 0]), c.words_n[c.language >= 0])
        self.language = np.where(spoken.max(axis=1) > 0, spoken.argmax(axis=1), -1)
        self.asks = c.query_language
        mixed = (self.language >= 0) & (self.asks >= 0) & (self.language != self.asks)
        # what is left open was mostly cut
        left_open = np.bincount(c.text, weights=np.isin(c.marks[:, 6] - _WORDS - sum((4, 7, 8, 18, 19, 34)), (5, 7)), minlength=len(rows)) if c.n else words
        self.pool = [i for i in range(len(rows)) if words[i] >= 12 and not echo[i] and not mixed[i] and not left_open[i] and any(t == _A for _, t in self.parts[i])]
        self.extras = [t for i in self.pool for t, tag in self.parts[i][:1] if tag == _X]
        self.tails = []
        for i in self.pool:
            n = next((k for k, (_, tag) in enumerate(reversed(self.parts[i])) if tag != _X), 0)
            if n:
                self.tails.append(self.parts[i][-n:])
        self.by_language: dict[int, list[int]] = {}
        self.keep([True] * len(rows))

    def keep(self, sound: list[bool]) -> None:
        self.pool = [i for i in self.pool if sound[i]] or self.pool
        self.by_language = {}
        for i in self.pool:
            self.by_language.setdefault(int(self.language[i]), []).append(i)

    def _said(self, s: str) -> list[int]:
        return self.tokens.read([s + " "])[0]

    def _led_in(self, k: str) -> list[tuple[list[int], int]]:
        x = self.rng.random()
        if x < 0.35 or not self.extras and x >= 0.7:
            return []
        return [(self._said(self.rng.choice(_LED_IN[k])), _X)] if x < 0.7 else [(self.rng.choice(self.extras), _X)]

    def _contact(self) -> list[tuple[list[int], int]]:
        """Now and then the extras that end another response."""
        return self.rng.choice(self.tails) if self.tails and self.rng.random() < 0.15 else []

    def _refusal(self, q: list[int], k: str) -> list[tuple[list[int], int]]:
        sorry, core, about, after = _REFUSALS[k]
        r = self.rng
        words = [i for i, x in enumerate(q) if self.tokens.kind[x] <= _CAP]
        topic: list[int] | None = None
        if len(words) > 4 and r.random() < 0.6:
            a = r.choice(words[:-2])
            topic = q[a : a + r.randint(2, 4)]
            topic = [x for x in topic if self.tokens.kind[x] <= _NUMBER]
        opening, text = r.choice(sorry), r.choice(core)
        if not opening or opening.endswith(": "):
            text = text[:1].upper() + text[1:]
        left, mid, right = text.partition("{t}")
        body = self.tokens.read([opening + left])[0] + ((topic or self.tokens.read([r.choice(about)])[0]) if mid else []) + self._said(right)
        self.tokens.know()
        out, part = [], []
        for x in body:  # a colon after the opening ends a clause
            part.append(x)
            if self.tokens.ends[x]:
                out.append((part, _R))
                part = []
        out += [(part, _R)] if part else []
        if len(out) > 1:
            out[0] = (out[0][0], _X)
        closing = r.choice(after)
        return out + ([(self._said(closing), _X)] if closing else [])

    def _echo(self, q: list[int]) -> list[int]:
        r, ids = self.rng, self.tokens.ids
        names = self._names
        x = [names[i] for i in q]
        how = r.random()
        if how < 0.15:
            x = [s.upper() for s in x]
        elif how < 0.3:
            x = [s.lower() for s in x]
        if r.random() < 0.3 and len(x) > 3 and not x[-1][0].isalnum():
            x = x[:-1]
        if r.random() < 0.25 and len(x) > 5:
            del x[r.randrange(min(3, len(x)))]
        if r.random() < 0.1:
            x = x + ["\n"] + x
        return [ids[s] for s in x]

    def _cut(self, t: list[int]) -> list[int]:
        """A clause broken off: within or after a word, a bracket, a list's number, a block of code."""
        r, ids, kind = self.rng, self.tokens.ids, self.tokens.kind
        how = r.random()
        if kind[t[0]] == _NUMBER and len(t) > 2 and self._names[t[1]].strip() in (".", ")") and how < 0.3:
            return [t[0], ids[self._names[t[1]].strip()]]
        if how < 0.05:
            return [ids[str(r.randint(2, 9))], ids["."]]
        if kind[t[0]] != _FENCE and how < 0.12:
            return [ids["```"], ids["\n"], *t[: r.randint(2, 5)]]
        end = r.randint(2, len(t) - 2)
        commas = [k for k in range(3, len(t) - 1) if kind[t[k - 1]] == _COMMA]
        t = t[: r.choice(commas) if commas and how < 0.3 else end]
        if self.tokens.ends[t[-1]] or kind[t[-1]] in (_STOP, _LINE):
            return []
        s = self._names[t[-1]]
        if how > 0.9:
            return [*t, ids["("], *t[-1 - r.randint(0, 1) :]]
        if len(s) > 3 and s.isalpha() and how > 0.6:
            return [*t[:-1], ids[s[: r.randint(1, len(s) - 1)]]]
        if how > 0.5:
            return [*t, ids["…"]] if r.random() < 0.5 else [*t, *[ids["."]] * 3]
        return t

    def make(self, n: int) -> tuple[list[list[int]], list[list[int]], list[list[int]]]:
        """Questions, responses, and the tag of every token of these."""
        r, out = self.rng, []
        if not self.pool:
            return [], [], []
        known = [k for k in self.by_language if 0 <= k < len(_LANGS) and _LANGS[k] in _REFUSALS]
        self._names = list(self.tokens.ids)
        for _ in range(n):
            what = r.random()
            # each language's refusals alike, and half of the others
            i = r.choice(self.by_language[r.choice(known)]) if known and (0.77 <= what < 0.93 or r.random() < 0.5) else r.choice(self.pool)
            q, parts = self.q[i], list(self.parts[i])
            k = _LANGS[self.asks[i]] if self.asks[i] >= 0 and _LANGS[self.asks[i]] in _REFUSALS else "en"
            if what < 0.30:
                if r.random() < 0.3:
                    parts = [*parts, *self._contact()]
            elif what < 0.46:
                at = [j for j, (t, tag) in enumerate(parts) if tag == _A and len(t) > 4]
                if not at:
                    continue
                fenced = [j for j in at if self.tokens.kind[parts[j][0][0]] == _FENCE]
                j = r.choice(fenced if fenced and r.random() < 0.6 else at)
                t = self._cut(parts[j][0])
                if not t:
                    continue
                parts = parts[:j] + [(t, _U)] + (self._contact() if r.random() < 0.1 else [])
            elif what < 0.63:
                others = [x for x in known if x != self.asks[i]]
                if self.asks[i] < 0 or not others:
                    continue
                to = r.choice(others)
                j = r.choice(self.by_language[to])
                other = self.parts[j]
                if r.random() < 0.25:
                    one = r.choice([x for x in other if x[1] == _A])
                    other = [one]
                if what < 0.57:
                    parts = [(t, _F if tag == _A else tag) for t, tag in other]
                elif what < 0.60:
                    parts, q = list(other), [*q, *self._said(" " + r.choice(_ASKING[_LANGS[to]]))]
                else:  # some of both
                    parts = parts + [(t, _F if tag == _A else tag) for t, tag in other[:1]]
            elif what < 0.71:
                echo = self._led_in(k) + [(self._echo(q), _E)] + self._contact() if q else []
                if not echo:
                    continue
                parts = echo
            elif what < 0.77:
                if not q:
                    continue
                parts = self._led_in(k) + [([*self._echo(q), self.tokens.ids["\n"]], _E)] + [x for x in parts if x[1] == _A][: r.randint(1, 4)]
            elif what < 0.90:
                parts = self._led_in(k) * (r.random() < 0.2) + self._refusal(q, k) + self._contact()
            elif what < 0.93:
                parts = self._refusal(q, k)[:1] + [x for x in parts if x[1] == _A][:2]
            elif what < 0.95:
                parts = self._led_in(k) * (r.random() < 0.3) + [r.choice([x for x in parts if x[1] == _A])] + self._contact()
            else:  # a value and its unit
                numbers = [(t, j) for t, tag in parts if tag == _A for j, x in enumerate(t[:-2]) if self.tokens.kind[x] == _NUMBER]
                if not numbers:
                    continue
                t, j = r.choice(numbers)
                if r.random() < 0.6:
                    t = [*t[:j], self.tokens.ids[str(r.choice((r.randint(1, 9), r.randint(10, 999))))], *t[j + 1 :]]
                    self.tokens.know()
                value = [self.tokens.ids["-"]] * (r.random() < 0.2) + [x for x in t[j : j + r.randint(1, 3)] if not self.tokens.ends[x]]
                parts = [([*value, *([self.tokens.ids["("], *t[:2], self.tokens.ids[")"]] if r.random() < 0.2 else [])], _A)]
            if r.random() < 0.03:  # no question: nothing is foreign to it
                q, parts = [], [(t, _A if tag in (_F, _E) else tag) for t, tag in parts]
            out.append((q, [x for t, _ in parts for x in t], [tag for t, tag in parts for _ in t]))
            self.tokens.know()
            if len(self._names) < len(self.tokens.ids):
                self._names += list(self.tokens.ids)[len(self._names) :]
        return [x[0] for x in out], [x[1] for x in out], [x[2] for x in out]


def tagged(tokens: Tokens, qs: list[list[int]], rs: list[list[int]], tags: list[list[int]]) -> tuple[Clauses, np.ndarray]:
    """Clauses of made pairs and the tag that most tokens of each have."""
    c = Clauses(tokens, qs, rs)
    flat = np.array([t for x, ts in zip(rs, tags) for t, i in zip(ts, x)], np.int64)
    ids = np.array([i for x in rs for i in x], np.int64)
    # the tokens that clauses keep, in the same order
    kept = np.zeros(len(flat), bool)
    j = 0
    for k, i in enumerate(ids.tolist()):
        if j < len(c.tok) and c.tok[j] == i:
            kept[k] = True
            j += 1
    votes = np.zeros((c.n, _K))
    np.add.at(votes, (c.token_clause, flat[kept]), 1)
    return c, votes.argmax(axis=1)


def train_on(rows: list[tuple[str | None, str]], examples: int = EXAMPLES, seed: int = 3) -> Field:
    """Trains twice: the second time without the sampled pairs that the first field finds defective."""
    rows = [(q, r) for q, r in rows if not is_standin(r)]
    tokens = Tokens()
    maker = Maker(rows, tokens, seed)
    first = train(*tagged(tokens, *maker.make(examples // 2)), rounds=4)
    found = defects([q for q, _ in rows], [r for _, r in rows], first)
    maker.keep([d is None for d in found])
    return train(*tagged(tokens, *maker.make(examples)))


# ---- defects -------------------------------------------------------------------------------------------


def defects(queries: list[str | None], responses: list[str | None], field: Field, tokens: Tokens | None = None) -> list[str | None]:
    """The defect of each pair, from the coverage of its clause tags."""
    tokens = tokens or Tokens()
    if len(tokens.ids) > 500_000:
        tokens.clear()
    c = Clauses(tokens, tokens.read(queries), tokens.read(responses))
    tags = field.tag(c)
    n = len(responses)
    size = np.maximum(1, c.words_n)
    cover = np.zeros((n, _K))
    np.add.at(cover, (c.text, tags), size)
    content = cover.sum(axis=1) - cover[:, _X]
    refusal, echo = (content > 0) & (cover[:, _R] == content), (content > 0) & (cover[:, _E] == content)
    # the language most of the answer is in
    told = (tags == _A) | (tags == _F) | (tags == _U)
    other = np.bincount(c.text, weights=(told & (tags == _F)) * size, minlength=n)
    wrong = (2 * other > np.bincount(c.text, weights=told * size, minlength=n)) & (c.query_language >= 0)
    final = np.full(n, -1)
    rows = np.flatnonzero(tags != _X)
    np.maximum.at(final, c.text[rows], rows)
    truncated = (final >= 0) & (tags[np.maximum(final, 0)] == _U) if c.n else np.zeros(n, bool)
    which = np.select([refusal, echo, wrong, truncated], [1, 2, 3, 4], 0)
    kinds = (None, "refusal", "echo", "wrong_language", "truncated")
    return ["empty" if is_standin(r) else kinds[k] for r, k in zip(responses, which.tolist())]


def defect(query: str | None, response: str | None, field: Field) -> str | None:
    return defects([query], [response], field)[0]


def _tag_pairs(field: Field):
    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens()
        for pdf in batches:
            k, q, r = pdf["k"].tolist(), pdf["q"].tolist(), pdf["r"].tolist()
            out = []
            for lo, hi in portions([len(x or "") + len(y or "") for x, y in zip(q, r)], 5000, 2_000_000):
                out += [(x, d) for x, d in zip(k[lo:hi], defects(q[lo:hi], r[lo:hi], field, tokens)) if d]
            yield pd.DataFrame(out, columns=["k", "defect"])

    return go


def broken_pairs(df: DataFrame, key: str, query: str, response: str) -> DataFrame:
    """(key, defect) of every defective pair."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(query).alias("q"), F.col(response).alias("r"))
    sample = rows.where(F.length("r").between(1, 4000)).orderBy(F.xxhash64("k"), "k", "r").limit(TRAIN_ROWS).collect()
    field = train_on([(x["q"], x["r"]) for x in sample])
    return spread(rows).mapInPandas(_tag_pairs(field), f"k {dict(rows.dtypes)['k']}, defect string").dropDuplicates(["k"]).withColumnRenamed("k", key)
