"""Operator 5: licence scan by canonical digests."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexmat.llm import common, license_texts

# Spellings that count as the same (from the public matching guidelines for licence texts).
EQUIVALENT = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized",
    "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize",
    "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling",
    "offence": "offense", "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize",
    "recognise": "recognize", "signalling": "signaling", "utilisation": "utilization", "whilst": "while", "wilful": "wilfull", "noncommercial": "non-commercial",
    "owner": "holder", "http": "https", "sublicence": "sublicense",
}
_WORDS = {a: " ".join(re.findall(r"[^\W_]+", b)) for a, b in EQUIVALENT.items()}
# Words that follow "copyright" where a licence's own sentence goes on in a line; any other line that begins with it names an owner.
_GOES_ON = "act|any|apply|are|as|by law|conditions|disclaimer|holder|holders|if|in|infringement|interest|interests|is|law|laws|licence|license|licenses|material|materials|may|must|notice|notices|on|or|owner|owners|patent|permission|protection|related|right|rights|similar|software|statement|statements|subject|such|terms|that|this|to|treaty|under|with|work|works"
_COPYRIGHT = re.compile(
    r"^[^\w\n]*(?:copyright|©|\(c\))(?=\W)(?:[^\n]*\d{4}[^\n]*|[^\n]*(?:©|\(c\))[^\n]*|[^\n]*all rights reserved[^\n]*)$|^[^\w\n]*all rights reserved\W*$"
    rf"|^[^\w\n]*(?:copyright|©|\(c\))[ \t]+(?![^\n]*\b(?:{_GOES_ON})\b)\w[^\n]{{0,80}}$",
    re.M,
)
_WORD = re.compile(r"[^\W_]+").findall
#: A list mark at the start of a line.
_BULLET = re.compile(r"[^\w\n(]*(?:\(?(?:\d{1,2}|[a-z])[.)]|[*•-])(?=\s)").match


def canonical_lines(text: str) -> list[str]:
    """Each line's words in lower case with single spaces: without copyright lines, list marks and punctuation, and with one
    of equivalent spellings."""
    text = text.lower()
    if "copyright" in text or "©" in text or "(c)" in text or "all rights" in text:
        text = _COPYRIGHT.sub("", text)
    out, same = [], _WORDS.get
    for line in text.split("\n"):
        m = _BULLET(line)
        out.append(" ".join([same(w, w) for w in _WORD(line[m.end() :] if m else line)]))
    return out


def canonical(text: str) -> str:
    """The words of all lines."""
    return " ".join(filter(None, canonical_lines(text)))


def digest(text: str) -> bytes:
    return hashlib.sha256(canonical(text).encode()).digest()


def forms(license_id: str, text: str) -> set[str]:
    """Canonical texts that a licence's text occurs in: with and without the advice after its terms, by postal address, and after a title line."""
    whole = canonical(text)
    out = {whole}
    for end in map(canonical, license_texts.ENDS):
        head, found, _ = whole.partition(end)
        if found:
            out |= {head.strip(), head + end}
    first, *older = map(canonical, license_texts.ADDRESSES)
    out |= {t.replace(first, a) for t in out for a in older}
    titles = {*license_texts.TITLES.get(license_id, ()), license_id, f"{license_id} License", f"The {license_id} License", f"{license_id} License ({license_id})", f"The {license_id} License ({license_id})"}
    return out | {f"{canonical(title)} {t}" for title in titles for t in out}


def _table(texts: dict[str, str] | None, notices: dict[str, str] | None) -> dict[str, str]:
    """Licence ids by canonical texts and notices."""
    out = {canonical(t): i for t, i in (license_texts.NOTICES if notices is None else notices).items()}
    for i, t in [*license_texts.TEXTS.items(), *license_texts.full_texts()] if texts is None else texts.items():
        out |= dict.fromkeys(forms(i, t), i)
    return out


def known(texts: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> dict[bytes, str]:
    """Licence ids by digest of their canonical texts (see forms()) and notices."""
    return {hashlib.sha256(t.encode()).digest(): i for t, i in _table(texts, notices).items()}


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", texts: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """(id, text_digest, license_id, notice_ids, n_notices) of each row.

    license_id is that of the licence whose canonical text the whole canonical text is, by a hash join on SHA-256 digests;
    notice_ids are the distinct licences, in order of name, whose known text or notice is a whole line; n_notices counts
    these lines. The digest table is a parameter of bounded size (the known texts), so it is broadcast. Only lines of
    as many words as some known text are hashed, which loses none.

    Null text counts as empty; a text without words has the digest of the empty text and no licence. Repeated rows are
    reported each; an empty table gives an empty result. Long texts are read whole. Of known texts that share a digest the
    last one gives the id. Ids may be of any type; other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    table = known(texts, notices)
    lengths = {len(t.split()) for t in _table(texts, notices)}
    src = docs.select(F.col(id_col).alias("_i"), common.text_of(text_col).alias("_t"))
    shared = spark.sparkContext.broadcast((table, lengths))

    def run(b: pa.RecordBatch) -> dict:
        names, sizes = shared.value
        whole, ids, n = [], [], []
        for t in b.column("_t").to_pylist():
            lines = canonical_lines(t)
            whole.append(hashlib.sha256(" ".join(filter(None, lines)).encode()).hexdigest())
            hits = [got for x in lines if x and x.count(" ") + 1 in sizes and (got := names.get(hashlib.sha256(x.encode()).digest()))]
            ids.append(sorted(set(hits)))
            n.append(len(hits))
        return {"_i": b.column("_i"), "text_digest": pa.array(whole, pa.string()), "notice_ids": pa.array(ids, pa.list_(pa.string())), "n_notices": pa.array(n, pa.int64())}

    kind = src.schema["_i"].dataType.simpleString()
    found = common.map_text(src, run, f"_i {kind}, text_digest string, notice_ids array<string>, n_notices long")
    names = spark.createDataFrame([(d.hex(), i) for d, i in sorted(table.items())] or [], "_d string, license_id string")
    out = found.join(F.broadcast(names), F.col("text_digest") == F.col("_d"), "left")
    return out.select(F.col("_i").alias(id_col), "text_digest", "license_id", "notice_ids", "n_notices")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
