"""Token counts: lengths only, from Arrow batches balanced by bytes.

Every text is cut at safe boundaries (before a blank that follows a visible
character), where no token of a byte-level vocabulary can span.  A piece is
counted by the library once and remembered per worker, within a fixed bound.
Texts with rare white space are cut likewise, but never after it: a run of blanks
of several kinds stays in one piece, as do separators (\\x1c to \\x1f) that are
blanks for some libraries only with what is around them.

Defined cases: a null or empty text has 0 bytes and 0 tokens; repeated rows
each give a row; a null id stays null; other columns are ignored; an empty
table gives an empty result.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from cellgrove.llm.common import plain, slices

#: Pieces remembered by a worker; beyond it, new pieces are counted but not kept.
CACHE_PIECES = 400_000
#: Bytes that one call of the library gets.
BATCH_BYTES = 1 << 18


def piece_counter(path: str):
    """texts -> their token counts, for a ``tokenizers`` file or a SentencePiece model."""
    import os
    import re
    import sys
    import types

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    kept = sys.modules.setdefault("_token_counts_of_worker", types.ModuleType("_token_counts_of_worker")).__dict__
    if path not in kept:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            kept[path] = (lambda xs: [len(i) for i in model.encode(xs, num_threads=1)], None)
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            kept[path] = (lambda xs: [len(e) for e in model.encode_batch_fast(xs, add_special_tokens=False)], {})
    encode, cache = kept[path]
    if cache is None:  # pieces of this kind of model may span blanks
        return encode
    cut = re.compile(r"[ \n\r\t]*[^ \n\r\t]+|[ \n\r\t]+").findall
    blank, unsure = " \n\r\t\x0b\x0c\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000", "\x1c-\x1f"
    rare = re.compile(f"[{blank[4:]}{unsure}]").search
    apart = re.compile(f"(?<=[^{blank}{unsure}])(?=[{blank}])").split

    def batches(xs):
        batch, size = [], 0
        for x in xs:
            batch.append(x)
            size += len(x.encode())
            if size >= BATCH_BYTES:
                yield batch
                batch, size = [], 0
        if batch:
            yield batch

    def counts(texts):
        out = []
        for x in texts:
            pieces = apart(x) if rare(x) else cut(x)
            found = list(map(cache.get, pieces))
            if None in found:
                new = {}
                for batch in batches({p for p, n in zip(pieces, found) if n is None}):
                    new.update(zip(batch, encode(batch)))
                found = [new[p] if n is None else n for p, n in zip(pieces, found)]
                if len(cache) < CACHE_PIECES:
                    cache.update((p, n) for p, n in new.items() if len(p) <= 64)
            out.append(sum(found))
        return out

    return counts


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row; no shuffle."""
    def count(batches):
        counts = None
        for b in batches:
            counts = counts or piece_counter(path)
            texts = plain(b.column(1))
            n_bytes = pa.compute.binary_length(texts).cast(pa.int64())
            n = []
            for at, m in slices(texts):
                n += counts(texts.slice(at, m).to_pylist())
            n = pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n_bytes, n, pa.compute.greater(n, limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    import pyarrow.compute  # noqa: F401

    return df.select(id_col, text_col).mapInArrow(count, f"{id_col} {df.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
