"""From texts to sections, chunks and batches. Folds over one text (or one book's rows) at a time, in Arrow batches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import patterns as P

_BLANKS, _GAPS = re.compile(r"[ \t]+"), re.compile(r"\n{3,}")
_CUT, _HEAD, _END = re.compile(P.SECTION_SPLIT), re.compile(P.HEADING), re.compile(r"(?<=[.!?])\s+")
_SENTENCE, _ABBREVIATION = re.compile(P.SENTENCE_END), re.compile(P.ABBREVIATION)
_TOKEN = re.compile(r"\w+|[^\w\s]")

Embed = Callable[[list[str]], np.ndarray]


def tidy(text: str) -> str:
    return _GAPS.sub("\n\n", _BLANKS.sub(" ", text)).strip()


def hashed_vector(texts: list[str], dim: int = 64) -> np.ndarray:
    """A stand-in for an embedder: unit vectors of hashed words and letter triples."""
    import zlib

    out = np.zeros((len(texts), dim))
    for i, t in enumerate(texts):
        t = t.lower()
        for f in re.findall(r"\w+", t) + [t[j : j + 3] for j in range(len(t) - 2)]:
            h = zlib.crc32(f.encode())
            out[i, h % dim] += 1 if h & 0x10000 else -1
    n = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, n, out=out, where=n > 0)


def sections(text: str, default: str = "Section", batch: int = 6000) -> list[tuple[str, str]]:
    """(title, text): cut before headings and chapter lines; parts under 20 characters go with the next. Without cuts, paragraphs in batches."""
    parts = [p for p in _CUT.split(text) if p.strip()]
    out: list[tuple[str, str]] = []
    if len(parts) > 1:
        held = ""
        for i, part in enumerate(parts, 1):
            body = tidy(part)
            if len(body) < 20:
                held = f"{held}\n\n{body}".strip()
                continue
            first = part.strip().split("\n", 1)[0].strip().lstrip("#").strip()
            out.append((first if len(first) <= 80 else f"Section {i}", f"{held}\n\n{body}" if held else body))
            held = ""
        if held and out:
            out[-1] = (out[-1][0], f"{out[-1][1]}\n\n{held}")
    elif len(tidy(text)) >= 20:
        run, size = [], 0
        for p in filter(None, map(tidy, text.split("\n\n"))):
            run.append(p)
            size += len(p)
            if size >= batch:
                out.append((f"{default} {len(out) + 1}", "\n\n".join(run)))
                run, size = [], 0
        if run:
            out.append((f"{default} {len(out) + 1}", "\n\n".join(run)))
    return out or ([(default, tidy(text))] if tidy(text) else [])


def subsections(text: str, default: str) -> list[tuple[str, str]]:
    """(subtitle, text) under each Markdown heading, with what stands before the first."""
    marks = list(_HEAD.finditer(text))
    spans = [(default, 0, marks[0].start() if marks else len(text))] + [(m.group(2).strip(), m.end(), n.start() if n else len(text)) for m, n in zip(marks, [*marks[1:], None][: len(marks)], strict=True)]
    return [(t, text[a:b].strip()) for t, a, b in spans if text[a:b].strip()] if marks else [(default, text)]


def _blocks(text: str) -> list[str]:
    """Paragraphs, with fenced code whole."""
    out: list[list[str]] = [[]]
    fenced = False
    for line in text.splitlines(keepends=True):
        fence = line.strip().startswith("```")
        if not fenced and not fence and not line.strip():
            out.append([])
            continue
        out[-1].append(line)
        if fence:
            fenced = not fenced
            if not fenced:
                out.append([])
    return [b for b in ("".join(x).strip() for x in out) if b]


def smart_split(text: str, most: int) -> list[str]:
    """Pieces of at most `most` characters where paragraphs, or sentences of longer ones, allow; code stays whole."""
    if len(text) <= most:
        return [text]
    out, held, size, glue = [], [], 0, "\n\n"

    def flush(joint: str) -> None:
        nonlocal held, size
        if held:
            out.append(joint.join(held))
        held, size = [], 0

    for block in _blocks(text):
        if size + len(block) + 2 > most:
            flush("\n\n")
        if len(block) > most and not block.startswith("```"):
            for s in _END.split(block):
                if size + len(s) + 1 > most:
                    flush(" ")
                held.append(s)
                size += len(s) + 1
        else:
            held.append(block)
            size += len(block) + 2
    flush(glue)
    return out or [text]


def split_sentences(text: str) -> list[tuple[str, bool]]:
    """(sentence, ends its paragraph). Headings and code are whole; abbreviations, initials and lower-case starts join what is before."""
    out: list[tuple[str, bool]] = []
    for para in re.split(r"\n\s*\n+", text.replace("\r\n", "\n").replace("\r", "\n")):
        para = para.strip()
        if not para:
            continue
        if para.startswith(("#", "```")):
            out.append((para, True))
            continue
        run: list[str] = []
        for s in filter(None, (x.strip() for x in _SENTENCE.split(para))):
            quoted = bool(run) and run[-1].endswith(('"', "'", "”", "’"))
            ended = bool(run) and run[-1].endswith((".", "!", "?", '"', "'", "”", "’"))
            joins = run and (_ABBREVIATION.search(run[-1]) or re.search(r"\b[A-Z]\.\s*$", run[-1]) or (re.match(r"[a-z0-9]", s) and not ended) or (re.match(r"[a-z]", s) and quoted))
            if joins:
                run[-1] += f" {s}"
            else:
                run.append(s)
        out += [(s, i == len(run) - 1) for i, s in enumerate(run)]
    return out


def count_tokens(text: str) -> int:
    return len(_TOKEN.findall(text))


def threshold(sims: np.ndarray, kind: str = "similarity_threshold", fixed: float = 0.5, amount: float = 95.0) -> float:
    """The similarity below which neighbours part: fixed, a low percentile, or deviations under the mean."""
    if not len(sims) or kind not in ("percentile", "standard_deviation"):
        return fixed
    return float(np.percentile(sims, min(100.0, max(0.0, 100.0 - amount)))) if kind == "percentile" else float(sims.mean() - amount * sims.std())


def _best_cut(cuts: list[tuple[float, int, bool]], paragraphs: bool) -> int:
    low = min(cuts)[0]
    near = low * 1.10 if low > 0 else low + 0.10
    good = [c for c in cuts if c[2] and c[0] <= near] if paragraphs else []
    return min(good or cuts, key=lambda c: (c[0], c[1]))[1]


def rolling_chunks(text: str, embed: Embed, window: int = 3, least: int = 150, most: int = 500, fixed: float = 0.5, kind: str = "similarity_threshold", amount: float = 95.0, overlap: int = 1, paragraphs: bool = True) -> list[dict]:
    """Chunks that end where the window of sentences on the left differs from that on the right, between `least` and `most` tokens."""
    pairs = split_sentences(text)
    if not pairs:
        return []
    said, ends = [p[0] for p in pairs], np.array([p[1] for p in pairs])
    n = len(said)
    _, sims = window_similarities(said, embed, window)
    upto = np.r_[0, np.cumsum([count_tokens(s) for s in said])]  # tokens before each sentence
    drops = sims < threshold(sims, kind, fixed, amount) * np.where(ends[: n - 1] & paragraphs, 1.10, 1.0)
    out, start, last = [], 0, -1
    while start < n:
        # a cut may stand behind the sentences from `low` (enough tokens, past the last cut) to `high` (not too many), all before the last
        low = max(last + 1, start, int(np.searchsorted(upto, upto[start] + least)) - 1)
        high = min(int(np.searchsorted(upto, upto[start] + most, "right")) - 1, n - 1)
        fits = np.arange(low, max(low, high))
        dropped = fits[drops[fits]] if len(fits) else fits
        cuts = [(float(sims[i]), int(i), bool(ends[i])) for i in fits]
        if len(dropped):
            cut, why = int(dropped[0]), "semantic_drop"
        elif max(high, low) < n - 1:
            cut, why = (_best_cut(cuts, paragraphs) if cuts else max(high, low)), "max_tokens_exceeded"
        elif cuts and upto[n] - upto[start] >= most:
            cut, why = _best_cut(cuts, paragraphs), "max_tokens_exceeded"
        else:
            cut, why = n - 1, "document_end"
        body = "".join(s + ("" if j == cut else "\n\n" if ends[j] else " ") for j, s in zip(range(start, cut + 1), said[start : cut + 1], strict=True))
        out.append({"chunk_idx": len(out), "text": body, "token_count": count_tokens(body), "char_count": len(body), "word_count": len(body.split()), "start_sentence": start, "end_sentence": cut, "split_reason": why})
        if cut >= n - 1:
            break
        last, start = cut, max(cut + 1 - overlap, start + 1)
    return out


def expanding_chunks(text: str, embed: Embed, limit: float = 0.20, most: int = 2500, least: int = 0) -> list[str]:
    """Chunks that grow by a sentence while that changes their vector by at most `limit`, up to `most` characters."""
    said = [s.strip() for s in _END.split(text) if s.strip()]
    out: list[str] = []
    held, vec = (said[0], embed([said[0]])[0]) if said else ("", None)
    for s in said[1:]:
        longer = f"{held} {s}"
        v = embed([longer])[0]
        n = float(np.linalg.norm(v) * np.linalg.norm(vec))
        distance = min(2.0, max(0.0, 1 - float(v @ vec) / n)) if n > 1e-12 else 1.0
        if (len(longer) > most and len(held) >= least) or distance > limit:
            out.append(held)
            held, vec = s, embed([s])[0]
        else:
            held, vec = longer, v
    return [*out, held] if held else out


def chunk_section(book_id: object, chapter: int, title: str, text: str, most: int = 1500, least: int = 100, split: Callable[[str], list[str]] | None = None) -> list[dict]:
    """A section's chunks with ids b{book}_c{chapter}_p{n}_{digest}: by subsection, short pieces put to the one before where that stays under 1.5 x most."""
    if len(text.strip()) < least and len(text.strip()) < 20:
        return []
    pieces: list[tuple[str, str]] = []
    for sub, body in subsections(text, title):
        for piece in (split or (lambda t: smart_split(t, most)))(body):
            if pieces and len(piece) < least and len(pieces[-1][1]) + len(piece) <= 1.5 * most:
                pieces[-1] = (pieces[-1][0], f"{pieces[-1][1]}\n\n{piece}")
            else:
                pieces.append((sub, piece))
    return [{"chunk_id": f"b{book_id}_c{chapter}_p{i}_{hashlib.sha256(t.encode()).hexdigest()[:8]}", "chapter_idx": chapter, "chunk_idx": i, "section_title": sub, "text": t, "char_count": len(t), "word_count": len(t.split())} for i, (sub, t) in enumerate(pieces, 1)]


def stitch(texts: list[str], least: int = 15, most: int = 600) -> str:
    """Consecutive chunks as one text: of an overlap of 15 to 600 characters, or of a shared sentence, one copy stays."""
    out = texts[0].strip() if texts else ""
    for t in filter(None, (x.strip() for x in texts[1:])):
        k = next((k for k in range(min(len(out), len(t), most), least - 1, -1) if out.endswith(t[:k])), 0)
        if not k:
            a, b = ([s for s in _END.split(x) if s] for x in (out, t))
            k = len(b[0]) if a and b and a[-1].strip() == b[0].strip() else 0
            out += t[k:] if k else f" {t}"
        else:
            out += t[k:]
    return out.strip()


def explode_texts(df: DataFrame, text: str, schema: str, make: Callable[[str], list[tuple]], keep: list[str]) -> DataFrame:
    """The columns `keep` and, for each row, the rows that make(text) gives. Null texts are empty."""
    from pyspark.sql import types as T

    kinds = T._parse_datatype_string(schema)
    names = [f.name for f in kinds.fields]
    own = df.select(*keep, F.col(text).alias("_text"))
    arrow = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    types = [arrow[f.dataType.simpleString()] for f in kinds.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [make(t or "") for t in batch.column(len(keep)).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(rows)), [len(r) for r in rows]))
            flat = [x for r in rows for x in r]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(len(keep))), *(pa.array([x[i] for x in flat], k) for i, k in enumerate(types))], [*keep, *names])

    return own.mapInArrow(run, T.StructType([*(own.schema[c] for c in keep), *kinds.fields]))


def batches(df: DataFrame, key: str, order: list[str], items: int) -> DataFrame:
    """df with batch (from 0): so many rows of a key at a time, in order."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1) / items))


def context(df: DataFrame, key: str, order: list[str], text: str = "text", chars: int = 500) -> DataFrame:
    """df with before and after: the last characters of the row before and the first of the row after, in the key's order; null at the ends."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumns({"before": F.right(F.lag(text).over(w), F.lit(chars)), "after": F.left(F.lead(text).over(w), F.lit(chars))})


def neighbour_pairs(df: DataFrame, key: str, order: list[str], text: str = "text", least: int = 40) -> DataFrame:
    """Distinct pairs (a, b) of texts that follow one another, both of `least` characters or more without the blanks around."""
    pairs = df.select(F.col(text).alias("a"), F.lead(text).over(Window.partitionBy(key).orderBy(*order)).alias("b"))
    return pairs.where((F.length(F.trim("a")) >= least) & (F.length(F.trim("b")) >= least)).distinct()


def sentence_similarities(text: str, embed: Embed, window: int = 3, fixed: float = 0.5, kind: str = "similarity_threshold", amount: float = 95.0) -> list[dict]:
    """What rolling_chunks sees at each place between two sentences: the similarity of the windows on both sides, the threshold, and whether a paragraph ends."""
    pairs = split_sentences(text)
    if len(pairs) <= 1:
        return []
    said = [p[0] for p in pairs]
    sides, sims = window_similarities(said, embed, window)
    limit = threshold(sims, kind, fixed, amount)
    return [{"split_idx": i, "sentence_before": said[i], "sentence_after": said[i + 1], "similarity": round(float(s), 4), "threshold": round(limit, 4), "is_below_threshold": bool(s < limit), "is_paragraph_end": pairs[i][1], "left_context": a, "right_context": b} for i, (s, (a, b)) in enumerate(zip(sims, sides, strict=True))]


def window_similarities(said: list[str], embed: Embed, window: int) -> tuple[list[tuple[str, str]], np.ndarray]:
    """The windows of sentences before and after each place between two, and their cosines."""
    sides = [(" ".join(said[max(0, i + 1 - window) : i + 1]), " ".join(said[i + 1 : i + 1 + window])) for i in range(len(said) - 1)]
    if not sides:
        return sides, np.zeros(0)
    left, right = (np.asarray(embed([s[j] for s in sides]), float) for j in (0, 1))
    norms = np.sqrt((left**2).sum(1) * (right**2).sum(1))
    return sides, np.divide((left * right).sum(1), norms, out=np.zeros_like(norms), where=norms > 1e-12)


def pack(df: DataFrame, key: str, order: list[str], size: Column, most: float, items: int | None) -> DataFrame:
    """df with batch (from 0): rows of a key in order, a new batch where the next row would pass `most` or `items`. An item over the limit stands alone."""
    sized = df.withColumn("_size", size.cast("double"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        batch, used, n, out = 0, 0.0, 0, []
        for s in rows["_size"].fillna(0.0):
            if n and (used + s > most or (items and n >= items)):
                batch, used, n = batch + 1, 0.0, 0
            used, n = used + s, n + 1
            out.append(batch)
        return rows.drop(columns="_size").assign(batch=out)

    from pyspark.sql import types as T

    return sized.groupBy(key).applyInPandas(run, T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())]))
