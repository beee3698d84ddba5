"""Problem 10: texts that are, or hold, template residue, filler, error pages or notices that scripts are needed.

Two kinds of evidence. Whole responses, whatever their wording: the terms of the address slug (doc_name), the title (first
line) and the body are compared; a text whose slug and title the body does not confirm, that says little of its own, whose
terms are strange to the collection and whose masked form is repeated, by the combined evidence of the hosts (source), is a
duplicated low-information response. Residue inside deeds: detectors for fields, instructions, failed substitutions,
messages and filler, families of patterns that each run only on texts with one of the family's literal anchors.

Defined results: null and blank texts, deeds that only speak of such things, signature lines and editorial marks
([sic], [L.S.]) are not flagged; repeated rows of a document give one row; all lengths are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekhya.session import materialise, nonempty

# Words of the customary filler text.
FILLER = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum".split()
)
# Bracketed words that editors of deeds write themselves.
EDITORIAL = frozenset("sic seal sealed signature signed illegible torn blank copy original stamp stamped faded erased deleted page folio note void cancelled".split())
_FIELD = (
    r"(?:[A-Za-z]+(?:_[A-Za-z0-9]+)+|[a-z]+[A-Z][A-Za-z]+|[A-Z][a-z]+[A-Z][A-Za-z]*|[a-z]{3,}\.[a-z]{3,}|[A-Za-z]{3,}\d{1,2}"
    r"|(?:DD|MM|YY|YYYY)[-/ .](?:DD|MM|YY|YYYY)(?:[-/ .](?:DD|MM|YY|YYYY))?|[●•]+|[A-Z][A-Z' ]{2,40}[A-Z]"
    r"|(?i:insert|enter|add|type|your|fill|write|choose|select|specify|describe|name of|date of|address of|amount of|details of|strike out|delete|click|to be (?:filled|inserted|confirmed))\b[^\[\]<>{}\n]{0,80}"
    r"|(?!(?i:no|same|said)\b)(?:[A-Za-z]+(?:'s)? ){1,4}(?i:name|address|amount|date|number|here|details))"
)
_ANY = r"[^\[\]<>{}«»%@\n]{1,80}"
# (family, anchors of which one must occur, pattern); the anchors of case-blind patterns are in lower case and sought in the lower-cased text
DETECTORS: list[tuple[str, tuple[str, ...], re.Pattern]] = [
    ("placeholder", ("{{", "}}"), re.compile(r"\{\{[^{}]{0,80}\}\}|\{%[^{}]{0,80}%\}")),
    ("placeholder", ("${", "#{", "{"), re.compile(r"[$#]\{[^{}\n]{1,80}\}|\{\d{1,2}\}|\{ ?[A-Za-z][A-Za-z0-9_.' /-]{1,60}\}")),
    ("placeholder", ("<%", "<?", "&lt;"), re.compile(r"<%[^%<>]{0,80}%>|<\?[^<>]{0,80}\?>|&lt;[^&\n]{1,60}&gt;")),
    ("placeholder", ("<",), re.compile(r"<<" + _ANY + r">>|<(?!/)[A-Za-z][A-Za-z0-9_.'/ -]{1,60}>")),
    ("placeholder", ("«", "‹", "⟨"), re.compile(r"[«‹⟨]" + _ANY + r"[»›⟩]")),
    ("placeholder", ("[[",), re.compile(r"\[\[" + _ANY + r"\]\]")),
    ("placeholder", ("%%", "@@", "~~", "||", "##"), re.compile(r"(%%|@@|~~|\|\||##)\s?[A-Za-z][A-Za-z0-9_.' /-]{1,60}\s?\1")),
    ("placeholder", ("__",), re.compile(r"(?<!_)__(?!_)[A-Za-z][A-Za-z0-9_.' -]{0,60}?[A-Za-z0-9](?<!_)__(?!_)")),
    ("placeholder", ("%",), re.compile(r"(?<![\w%])%(?:[sdf]\b|\([a-z_]+\)[sdf]|[A-Z][A-Z_]{2,40}%)")),
    ("placeholder", ("xx", "●"), re.compile(r"\b[Xx]{2}[-/.][Xx]{2}[-/.][Xx]{2,4}\b|(?:Rs\.?|INR|₹)\s?[Xx]{3,}|\b(?:[Xx]{4,}\b[ -]?){1,}|[●]{1,} ?(?:square|rupees|day|years)")),
    ("instruction", ("TODO", "FIXME", "TBD", "T.B.D", "TBC"), re.compile(r"\b(?:TODO|FIXME|TBD|TBC)\b\s?[:;\-–(]|\((?:TBD|TBC)\)|\b(?:TODO|FIXME)\b")),
    ("instruction", ("(strike out", "(delete", "(insert", "(fill in", "(tick", "(specify", "to be ", "(here ", "insert ", "fill in ", " here to ", "click to "), re.compile(r"(?i)\b(?:click|tap|press|touch|type|write|enter)(?: or (?:click|tap))?(?: here)? to (?:add|edit|enter|insert|type|fill|write|choose|select)\b|\([^()\n]{0,60}\bto be (?:typed|filled|inserted|entered|added|written|completed|supplied|confirmed)\b[^()\n]{0,40}\)|\((?:strike out|delete|insert|fill in|tick|specify|to be filled|here (?:insert|enter|set out))\b[^()\n]{0,80}\)|<?\b(?:insert|fill in) [a-z' ]{2,40} here\b")),
    ("substitution", ("NaN", "#REF!", "#VALUE!", "#N/A", "#NAME?", "#DIV/0!", "#NULL!", "#NUM!", "[object Object]", "&nbsp;", "(null)", "None None", "&amp;nbsp"), re.compile(r"(?<![A-Za-z])NaN(?![A-Za-z])|#(?:REF!|VALUE!|N/A|NAME\?|DIV/0!|NULL!|NUM!)|\[object Object\]|(?:&nbsp;|&amp;nbsp;)|\(null\)|\bNone None\b")),
    ("substitution", ("undefined", "null"), re.compile(r"\bundefined (?:son|daughter|wife|of|at|undefined|null)\b|\b(?:son|daughter|wife|resident) of (?:null|undefined)\b|\b(?:null|undefined)[, ]+(?:null|undefined)\b|\b(?:Rs\.?|INR|₹|No\.?:?|dated|on|at|by|aged) (?:null|undefined)\b(?! and void)")),
    ("script", ("javascript", "noscript", "js"), re.compile(r"(?i)<\s?noscript|(?:enable|activate|turn on|switch on|requires?|needs?|without) (?:javascript|js)\b|(?:javascript|js) (?:is|must be|should be|has to be|seems to be|appears to be) (?:disabled|enabled|turned off|turned on|switched off|switched on|required|off|blocked|not enabled)|javascript (?:required|disabled)")),
    ("script", ("browser", "script", "cookies"), re.compile(r"(?i)\bneeds? (?:scripts|cookies)[^.\n]{0,60}\b(?:browser|switched on|turned on|enabled)|allow cookies|(?:enable|accept|allow) (?:scripts?|cookies|scripting)|activate scripting|your browser (?:does not|doesn't|is not|isn't|is too)|(?:scripts?|cookies) (?:are|is|must be) (?:disabled|blocked|turned off|required|enabled)|(?:scripts|cookies) (?:to|and \w+ to) continue")),
    ("script", ("जावास्क्रिप्ट", "कुकी", "ब्राउज़र", "ब्राउजर"), re.compile(r"जावास्क्रिप्ट|(?:कुकी|ब्राउज़र|ब्राउजर)[^।\n]{0,60}(?:चालू|सक्षम|अनुमति|समर्थन)")),
    ("error", ("not found", "gateway", "forbidden", "internal server", "bad request", "unauthori", "http", "error", "unavailable", "too many requests"), re.compile(r"(?i)\b[45]\d\d\b\s?[-–:|]?\s?(?:error\b|(?:page )?not found|bad gateway|forbidden|internal server error|bad request|unauthori[sz]ed|gateway time-?out|service unavailable|too many requests)|\b(?:http|https?)(?:/\d\.\d)?\s?(?:status|error|code)?\s?:?\s?[45]\d\d\b|\berror (?:code )?[45]\d\d\b|internal server error|bad gateway")),
    ("error", ("went wrong", "denied", "unavailable", "too many requests", "expired", "you are looking", "located on this server", "maintenance", "under construction", "timed out", "try again later", "have permission", "could not render", "requested"), re.compile(r"(?i)something went wrong|\baccess denied\b|you do not have permission|(?:service|site|page|server) (?:is )?(?:temporarily |currently )?unavailable|temporarily unavailable|too many requests|session has (?:expired|timed out)|(?:page|record|document|file) you (?:are looking for|requested)|requested (?:record|page|url|file|document)[^.\n]{0,40}(?:could not be|was not|not) (?:located|found)|not be located on this server|\bis under (?:scheduled )?maintenance|under construction\. *|(?:request|connection|gateway|session) timed out|please try again later|could not render this")),
    ("error", ("traceback", "exception", "error", "stack trace", "segmentation", "warning:"), re.compile(r"\bTraceback\b|\b(?:IO|Value|Key|Type|Runtime|Null\w*|Syntax|OS|Name|Attribute)Error\b|\b\w+Exception\b|(?i:stack trace|fatal error|segmentation fault)|\bWarning: \w+\(")),
    ("error", ("त्रुटि", "पृष्ठ नहीं", "अनुपलब्ध", "सर्वर"), re.compile(r"त्रुटि\s*[0-9०-९]{3}|पृष्ठ नहीं मिला|सेवा[^।\n]{0,30}अनुपलब्ध|सर्वर त्रुटि")),
    ("filler", ("dummy text", "sample text", "coming soon", "test test", "asdf", "qwerty", "placeholder text", "before publishing", "goes here", "text here", "please ignore"), re.compile(r"(?i)\bdummy text\b|\bsample text (?:for|only|here)|(?:content|more) coming soon|\btest test\b|\basdf\b|\bqwerty\b|\bplaceholder text\b|\breplace (?:this )?before publishing|\b(?:text|clause|content|name|description)\b[^.\n]{0,40}\bgoes here\b|\b(?:your|the) [a-z ]{0,30}text here\b|\bupload \w+ please ignore")),
    ("filler", ("यहाँ", "यहां"), re.compile(r"(?:यहाँ|यहां) (?:अपना|पाठ|लिखें|भरें|नाम|टाइप)|नमूना पाठ")),
]
_CASE_BLIND = tuple("(?i" in pattern.pattern or "[Xx]" in pattern.pattern for _, _, pattern in DETECTORS)
_BRACKET = re.compile(r"\[([^\[\]\n]{1,100})\]")
_BRACKET_FIELD = re.compile(_FIELD)
_WORD = re.compile(r"[a-z]+")
_SLUG = re.compile(r"[^\W\d_]{2,}")
_EDGES = ".,;:!?()[]{}<>\"'“”‘’।-–—/*#|"
_MASK = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b|\d+")


def has_filler(text: str, run: int = 6, share: float = 0.8) -> bool:
    """Whether some `run` consecutive words are, to `share`, words of the customary filler text."""
    low = text.lower()
    if not any(w in low for w in ("lorem", "ipsum", "dolor", "amet", "adipiscing", "nostrud", "ullamco", "veniam", "aliqua", "commodo", "voluptate")):
        return False
    hits = [w in FILLER for w in _WORD.findall(low)]
    need, now = run * share, 0
    for i, h in enumerate(hits):
        now += h - (hits[i - run] if i >= run else 0)
        if now >= need:
            return True
    return False


def evidence(text: str) -> list[str]:
    """The kinds of residue that a text shows by itself, in order of detection, each once."""
    low = text.lower()
    kinds = []
    for (kind, anchors, pattern), blind in zip(DETECTORS, _CASE_BLIND):
        where = low if blind else text
        if any(a in where for a in anchors) and pattern.search(text):
            kinds.append(kind)
    if "[" in text:
        for inner in _BRACKET.findall(text):
            inner = inner.strip()
            if inner.lower().strip(".") not in EDITORIAL and "/" not in inner.replace("DD/MM", "") and _BRACKET_FIELD.fullmatch(inner):
                kinds.append("placeholder")
                break
            if inner.lower() in ("strike out whichever is not applicable", "delete whichever is not applicable"):
                kinds.append("instruction")
    if has_filler(text):
        kinds.append("filler")
    return list(dict.fromkeys(kinds))


def masked_form(text: str) -> str:
    """The text without numbers and hexadecimal ids, white space folded: equal for copies of one response."""
    return " ".join(_MASK.sub("#", text.lower()).split())


class _Memo(dict):
    """A bounded cache of a function of one word."""

    def __init__(self, f, most: int = 300_000):
        self.f, self.most = f, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        out = self[key] = self.f(key)
        return out


#: A lower-cased word without punctuation, '' for numbers.
_TERM = _Memo(lambda w: "" if any(c.isdigit() for c in w) else w.strip(_EDGES))
#: What a word is: 1 for a number, 2 for a capital, 4 for the end of a sentence.
_SORT = _Memo(lambda w: 1 * any(c.isdigit() for c in w) | 2 * w[0].isupper() | 4 * (w[-1] in ".!?:।"))


def _terms(text: str) -> set[str]:
    """Lower-cased words of any script without numbers."""
    out = {_TERM[w] for w in set(text.lower().split())}
    out.discard("")
    return out


def profile(doc_name: str | None, text: str, terms: set[str]) -> tuple[float, float, int]:
    """(mismatch, low, specifics) of a text, wording apart; `terms` are those of the whole text.

    low: how little the text says of its own; specifics are the numbers, and the names (capitals inside a sentence), and a text of
    which a fifth of the words are specific has 0.
    mismatch: how few of the terms of the address slug and the title (first line) the body confirms; 0 where at least two do. It is
    compared only for texts with low > 0, and 0 for others.
    """
    sorts = np.frombuffer(bytes(map(_SORT.__getitem__, text.split())), dtype=np.uint8)
    inner = (sorts[1:] & 2 > 0) & (sorts[:-1] & 4 == 0) & (sorts[1:] & 1 == 0)
    specifics = int((sorts & 1).sum()) + int(inner.sum())
    low = max(0.0, 1 - specifics / (0.2 * max(1, len(sorts))))
    if not low:
        return 0.0, low, specifics
    title, _, body = text.strip().partition("\n")
    slug = _SLUG.findall((doc_name or "").rpartition(".")[0].lower())
    head = {w for w in _terms(title) | set(slug) if len(w) > 3} & terms
    return 1 - min(len(head & _terms(body)), 2) / 2, low, specifics


def score_documents(documents: DataFrame, threshold: float = 2.75, chance: float = 1e-5, rare: float = 0.005) -> DataFrame:
    """(doc_id, kinds, score, host_copies): one row per document that shows residue; kinds is an array of evidence names.

    `duplicated` is given by the sum of four kinds of evidence, each from 0 to 1, for texts of any length:
    mismatch and low as in profile; off-topic: the share of the text's terms that under `rare` of all records with content of
    their own hold, 1 from three in ten on; repeated: the bits by which the copies of its masked form on each host (source)
    exceed what a rate of `chance` of the host's records explains, added up over the hosts, with one bit for each doubling of
    the hosts, 1 from two bits on. Texts with low under 0.1 have content of their own and are not judged. The rates are shares, so a table of any size is judged alike. One scan of the texts; counts
    are added up in the tasks before they are shuffled.
    """

    @nonempty
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["doc_id", "source", "kinds", "form", "base", "terms", "term", "n"]
        heads: Counter = Counter()
        records = 0

        def counts() -> pd.DataFrame:
            k = len(heads)
            nothing = [None] * k
            return pd.DataFrame(dict(zip(cols, (nothing, nothing, nothing, nothing, nothing, nothing, list(heads), list(heads.values())))), columns=cols)

        for b in batches:
            rows = []
            for doc, name, source, text in zip(b["doc_id"], b["doc_name"], b["source"], b["text"]):
                if not text or not text.strip():
                    continue
                found = evidence(text)
                own = _terms(text)
                mismatch, low, specifics = profile(name, text, own)
                if specifics >= 4:
                    heads.update(own)
                    records += 1
                alone = low >= 0.1 and mismatch + low > threshold - 2  # the other two add at most 2
                if found or alone:
                    rows.append((doc, source or "", found, masked_form(text) if alone else None, mismatch + low if alone else None, list(own) if alone else None, None, None))
            yield pd.DataFrame(rows, columns=cols)
            if len(heads) > 300_000:
                yield counts()
                heads.clear()
        heads[""] = records
        yield counts()

    schema = "doc_id long, source string, kinds array<string>, form string, base double, terms array<string>, term string, n long"
    docs = documents.filter("doc_id IS NOT NULL").select("doc_id", "doc_name", "source", "text")
    seen = docs.mapInPandas(run, schema).withColumn("form", F.when(F.col("form").isNotNull(), F.xxhash64("form")))
    seen = materialise(seen, "residue")
    hits = seen.filter("doc_id IS NOT NULL").select("doc_id", "source", "kinds", "form", "base", "terms").dropDuplicates(["doc_id"])
    alone = hits.filter("form IS NOT NULL")

    df = seen.filter("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("n"))
    records = df.filter("term = ''").agg(F.max("n")).first()[0] or 0
    forms = alone.groupBy("form").agg(F.min_by("terms", "doc_id").alias("terms"))
    common = df.filter((F.col("n") >= rare * records) & (F.col("term") != "")).select("term", F.lit(1).alias("known"))
    topics = forms.select("form", F.explode("terms").alias("term")).join(common, "term", "left").groupBy("form").agg((1 - F.count("known") / F.count("*")).alias("off"))

    hosts = documents.filter("doc_id IS NOT NULL").groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("size"))
    per_host = alone.groupBy("form", "source").agg(F.count("*").alias("c")).join(hosts, "source")
    bits = F.greatest(F.lit(0.0), F.log2("c") - F.log2(1 + F.col("size") * chance))
    copies = per_host.groupBy("form").agg((F.sum(bits) + F.log2(F.count("*"))).alias("bits"), F.sum("c").alias("host_copies"))

    judged = hits.join(topics, "form", "left").join(copies, "form", "left")
    extra = F.least(F.lit(1.0), F.col("off") / 0.3) + F.least(F.lit(1.0), F.col("bits") / 2)
    judged = judged.withColumn("score", F.round(F.col("base") + extra, 4))
    dup = F.coalesce((F.col("bits") > 0) & (F.col("score") >= threshold), F.lit(False))
    kinds = F.when(dup, F.array_union("kinds", F.array(F.lit("duplicated")))).otherwise(F.col("kinds"))
    return judged.select("doc_id", kinds.alias("kinds"), "score", "host_copies").filter(F.size("kinds") > 0)


def found(documents: DataFrame) -> DataFrame:
    """p10_found: the documents to be excluded."""
    return score_documents(documents).select("doc_id")
