"""Problem 10: template residue and error pages in place of content.

Texts are cut into segments, and a fixed-depth prefix tree sorts their messages into templates: a leaf is the number of words, the first
three and the last two, with figures masked; a template holds the words its messages share and a wildcard elsewhere. A classifier of
templates is trained on a bounded sample of them, whose labels come from where a template stands: error pages stand in documents
without sentences of their own and hold a word of known ones or come back in several documents; filler is repeated in its document
or begins like known filler. Each template is classified once, and
verdicts go back to the documents by a join. Slots left unresolved are looked for in every record by themselves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import stored

# Slots of common template languages, and what they leave when no value was found.
SLOTS = [
    r"\{\{[^{}\n]+\}\}", r"\{%[^%\n]+%\}", r"[$#]\{[^{}\n]+\}", r"\{\d{1,2}\}", r"%%[A-Z][A-Z0-9_]*%%", r"(?<![%A-Za-z0-9_])%[A-Z][A-Z0-9_]+%(?![A-Za-z0-9_])", r"@@[A-Z][A-Z0-9_]*@@",
    r"__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__", r"\[\[[^\[\]\n]+\]\]", r"<<[A-Z][A-Z0-9 _]*>>", r"<(?:insert|enter|your|name of) [^<>\n]+>", r"\[(?:insert|enter|your) [^\[\]\n]+\]",
    r"\[INSERT [^\[\]\n]+\]", r"\[[A-Z]{2,}(?: [A-Z]{2,})+\]", r"\[[^\[\]\n]+ to be (?:inserted|completed|confirmed)\]", r"\[[●•]\]", r"\bXX/XX/(?:20)?XX",
    r"#(?:REF!|N/A|VALUE!|NAME\?|DIV/0!)", r"\[object Object\]", r"(?<![\p{L}\p{N}_])(?:undefined|NaN|xxx)(?![\p{L}\p{N}_]|[-'])", r"(?<![\p{L}\p{N}_-])null(?![\p{L}\p{N}_-]| (?:and|und|et|y|e) )",
    r"(?<=[\p{Ll}\p{N},] )None(?= [\p{Ll}]|[.,;])(?! of\b)", r"(?:^|(?<=[\p{L}\p{N} ]))\?\?\?(?=[\p{L}\p{N} .,;。，])", r"(?:^|(?<=\n))None(?= [\p{Ll}])(?! of\b)",
]
# Filler a template's author meant to be replaced, as a segment begins.
FILLER = (
    r"^\W*(?:text goes here|heading goes here|title goes here|sample (?:paragraph|text)|replace this text|dummy (?:copy|text)|placeholder text|content coming soon|check back later|your text here|insert text here|"
    r"在此輸入|此處為示範文字|內容即將推出|texto de (?:ejemplo|exemplo)|texte (?:provisoire|d'exemple|à remplacer)|contenu bientôt disponible|blindtext|platzhaltertext|mustertext|beispieltext|inhalt folgt|"
    r"contenido disponible próximamente|conteúdo disponível em breve|título de (?:ejemplo|exemplo)|überschrift hier|titre ici|lorem ipsum)"
)
# The public filler text.
LOREM = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()

# A few words of error pages and demands for scripts in each language, which label templates for training.
SEEDS = (
    r"javascript|scripts?\b|cookies|\b(?:4\d\d|50\d)\b|not found|could not be found|forbidden|denied|error\b|unavailable|maintenance|timeout|expired|log in|"
    r"找不到|錯誤|拒絕|維護|逾時|腳本|"
    r"nicht gefunden|verweigert|fehler|wartung|abgelaufen|introuvable|refusé|erreur|indisponible|expirée?|"
    r"no encontrad|denegad|mantenimiento|caducad|não encontrad|negado|erro\b|manutenção|expirad"
)

SLOT, SEED, OPENING = regex.compile("|".join(SLOTS)), regex.compile(SEEDS, regex.I), regex.compile(FILLER, regex.I)
#: Characters and words one of which every slot holds.
SIGNS = regex.compile(r"[{@_\[<#]|%[A-Z%]|\?\?\?|XX/XX|undefined|NaN|xxx|null|None")
CUT = regex.compile(r"\r?\n|(?<=[。！？])|(?<=[.!?])\s+|(?<=\p{Ll}[.!?])(?=\p{Lu})| \| | - (?=\p{Lu})|(?<=\p{L}): (?=\p{Lu})")
WORD = regex.compile(r"[一-鿿]|[^\W_一-鿿]+(?:'[^\W_]+)*")
STOP = regex.compile(r"[.!?。！？;；][)”\"']?\s*$")
FIGURES = {ord(c): "0" for c in "123456789"}
BLANK = regex.compile(r"(?<=[一-鿿]) (?=[一-鿿])")
#: Of a message's path in the tree: words at its beginning and at its end.
HEAD, TAIL = 3, 2
#: Hashed features of the classifier, and its classes: content, message of an error page, filler.
WIDTH, CLASSES = 1 << 14, 3
#: Sentences of its own that a document may have and still be one that holds none but messages.
FEW = 2
#: Documents in which a message comes back, where no word tells it.
SEVERAL = 3


def messages(text: str) -> list[tuple[list[str], bool]]:
    """The words of each segment of a text, figures masked, and whether it reads like a sentence: long (a Chinese character weighs as
    three letters) and closed by a stop."""
    out = []
    for s in CUT.split(text):
        words = ["0" if "0" in w else w for w in WORD.findall(s.lower().translate(FIGURES))] if s else []
        if words:
            letters = sum(3 if "一" <= w[0] <= "鿿" else len(w) for w in words)
            out.append((words, letters >= 25 and STOP.search(s) is not None))
    return out


def leaf_of(words: list[str]) -> int:
    path = f"{len(words)}|{' '.join(words[:HEAD])}|{' '.join(words[-TAIL:])}".encode("utf-8", "surrogatepass")
    return (zlib.crc32(path) << 32 | zlib.crc32(path, 0x5BD1E995)) - (1 << 63)


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, slot, leaf, words, full, again, sentences, seeded): each leaf of a document once, with its first message, whether one of its
    messages reads like a sentence or comes again in the document, the document's number of sentences, and whether it has hardly any and a word of known error pages. A document with a slot has
    one more row, of no leaf."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, text in zip(b.doc_id, b.text):
                own: dict[int, list] = {}
                found = messages(text)
                sentences = sum(full for _, full in found)
                seeded = sentences <= FEW and SEED.search(text) is not None
                for words, full in found:
                    m, at = " ".join(words), leaf_of(words)
                    if at in own:
                        held = own[at]
                        held[1] |= full
                        held[2] |= held[0] == m
                    else:
                        own[at] = [m, full, False]
                rows += [(k, False, at, m, full, again, sentences, seeded) for at, (m, full, again) in own.items()]
                if SIGNS.search(text) and SLOT.search(text):
                    rows.append((k, True, None, None, False, False, sentences, seeded))
            out = pd.DataFrame(rows, columns=["doc_id", "slot", "leaf", "words", "full", "again", "sentences", "seeded"])
            yield out.astype({"leaf": "Int64"})

    given = docs.where("doc_id is not null and text rlike '\\\\S'").select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return given.mapInPandas(work, f"doc_id {kind}, slot boolean, leaf bigint, words string, full boolean, again boolean, sentences int, seeded boolean")


def templates(found: DataFrame) -> DataFrame:
    """(leaf, low, high, support, bare, seeded, again): each template of the tree with its first and last message, the number of its documents,
    and the shares of them that have hardly a sentence, that have a known word beside, and that hold it more than once. Combined on the map side, so a message on every
    page costs no more than any other."""
    return found.where("leaf is not null").groupBy("leaf").agg(
        F.min("words").alias("low"), F.max("words").alias("high"), F.count("*").alias("support"), F.avg((F.col("sentences") <= FEW).cast("double")).alias("bare"), F.avg(F.col("seeded").cast("double")).alias("seeded"),
        F.avg(F.col("again").cast("double")).alias("again"),
    )


def template(low: str, high: str) -> list[str]:
    """The words two messages of a leaf share, with a wildcard elsewhere."""
    return [a if a == b else "*" for a, b in zip(low.split(" "), high.split(" "))]


def opens(words: list[str]) -> bool:
    """Whether a message begins like known filler; Chinese words stand without blanks."""
    return OPENING.search(BLANK.sub("", " ".join(words))) is not None


def _features(words: list[str]) -> list[int]:
    known = [w for w in words if w != "*"]
    names = known + [f"{a}_{b}" for a, b in zip(words, words[1:]) if "*" not in (a, b)] + [f"^{words[0]}", f"n{min(len(words), 12)}", f"lorem{min(3, sum(w in _LOREM for w in known))}", f"open{opens(words)}"]
    return sorted({zlib.crc32(x.encode("utf-8", "surrogatepass")) % WIDTH for x in names})


_LOREM = set(LOREM)


def label(words: list[str], support: int, bare: float, seeded: float, again: float) -> int | None:
    """What a template is taken for in training, from where it stands and how it begins; None where that doesn't tell."""
    filler = sum(w in _LOREM for w in words)
    if again >= 0.5 or opens(words) or (filler >= 3 and filler >= 0.25 * len(words)):
        return 2
    if (bare >= 0.5 and seeded >= 0.5) or (bare >= 0.9 and support >= SEVERAL):
        return 1
    return 0 if bare < 0.9 else None


class Classifier:
    """A softmax over hashed words and pairs of words of a template."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias = weights, bias

    @classmethod
    def train(cls, rows: list[tuple[list[str], int]], steps: int = 150, rate: float = 0.05, l2: float = 3e-5) -> Classifier:
        w, bias = np.zeros((WIDTH, CLASSES)), np.zeros(CLASSES)
        if not rows:
            return cls(w, np.array([1.0, 0.0, 0.0]))
        feats = [_features(x) for x, _ in rows]
        size = np.array([len(f) for f in feats])
        row, col, scale = np.repeat(np.arange(len(rows)), size), np.concatenate(feats), 1 / np.sqrt(size)
        gold, past = np.eye(CLASSES)[[y for _, y in rows]], np.zeros_like(w)
        for step in range(steps):
            z = np.stack([np.bincount(row, w[col, c], len(rows)) for c in range(CLASSES)], 1) * scale[:, None] + bias
            p = np.exp(z - z.max(1, keepdims=True))
            off = (p / p.sum(1, keepdims=True) - gold) * scale[:, None]
            g = np.stack([np.bincount(col, off[row, c], WIDTH) for c in range(CLASSES)], 1) / len(rows) + l2 * w
            past = 0.9 * past + (0.1 if step else 1.0) * g**2
            w -= rate * g / (np.sqrt(past) + 1e-8)
            bias -= 0.5 * (off / scale[:, None]).mean(0)
        return cls(w, bias)

    def chances(self, words: list[str]) -> np.ndarray:
        f = _features(words)
        z = self.weights[f].sum(0) / np.sqrt(len(f)) + self.bias
        p = np.exp(z - z.max())
        return p / p.sum()


def trained(found: DataFrame, sample: int = 6000) -> Classifier:
    """A classifier trained on at most sample templates by a hash of the leaf, and at most half as many more of those that stand in
    documents without sentences or come again in them (a documented, bounded sample)."""
    ordered = found.orderBy(F.xxhash64("leaf"))
    rare = found.where("bare >= 0.5 or again >= 0.5").orderBy(F.xxhash64("leaf"))
    rows = {r.leaf: r for x in (ordered.limit(sample), rare.limit(sample // 2)) for r in x.collect()}  # at most 1.5 * sample
    given = [(template(r.low, r.high), r) for _, r in sorted(rows.items())]
    return Classifier.train([(w, y) for w, r in given if (y := label(w, r.support, r.bare, r.seeded, r.again)) is not None])


def verdicts(found: DataFrame, model: Classifier, least: float = 0.5) -> DataFrame:
    """(leaf, message, filler) of templates that aren't content. A leaf whose first and last message share less than half of their
    words is no single template: it is residue only where both of them are."""
    shared = found.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for b in batches:
            rows = []
            for at, low, high in zip(b.leaf, b.low, b.high):
                words = template(low, high)
                kinds = [words] if 2 * words.count("*") <= len(words) else [low.split(" "), high.split(" ")]
                p = [own.chances(x) for x in kinds]
                filler = all(opens(x) or (c[0] < 1 - least and (c[2] >= c[1] or sum(w in _LOREM for w in x) >= 2)) for x, c in zip(kinds, p))
                if filler or all(c[0] < 1 - least for c in p):
                    rows.append((at, not filler, filler))
            yield pd.DataFrame(rows, columns=["leaf", "message", "filler"])

    return found.select("leaf", "low", "high").mapInPandas(work, "leaf bigint, message boolean, filler boolean")


def residue_documents(docs: DataFrame, reasons: bool = False, sample: int = 6000) -> DataFrame:
    """(doc_id) of records to leave out, with reasons also (slot, filler, message): booleans.

    slot: an unfilled slot or its left-over value anywhere; filler: a template of filler text anywhere; message: templates of error pages
    or demands for scripts in a document without any sentence of other content. Null, empty and blank texts are no cases; repeated
    doc_ids count once.
    """
    cut = stored(leaves(docs))
    mined = stored(templates(cut))
    told = verdicts(mined, trained(mined, sample))
    both = cut.select("doc_id", "slot", "leaf", "full").join(told, "leaf", "left")
    says = F.coalesce("message", F.lit(False))
    filler = F.coalesce("filler", F.lit(False))
    out = both.groupBy("doc_id").agg(F.bool_or("slot").alias("slot"), F.bool_or(filler).alias("filler"), (F.bool_or(says) & ~F.bool_or(F.col("full") & ~says & ~filler)).alias("message"))
    out = out.where("slot or filler or message")
    return out if reasons else out.select("doc_id")
