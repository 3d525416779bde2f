"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are gathered until a batch holds ENCODE_BYTES, whatever their number, so that batches cost alike. A text
over SPLIT_CHARS is cut in front of single spaces between two other characters. Byte-level pre-tokenizers that split by pattern, without a
prefix space, never put such a space behind another character into one token, so the parts' counts add up to the whole's. Other tokenizers, and those with an added
token that holds or strips spaces, get every text whole.

Null and empty texts have 0 bytes and 0 tokens. Repeated rows stay repeated rows; rows without an id keep their null. An empty table gives an empty one. Columns besides id and
text, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_arrow
from quire.shipping import ship

ENCODE_BYTES = 1 << 18
SPLIT_CHARS = 1 << 15


def pieces(text: str, limit: int = SPLIT_CHARS) -> list[str]:
    """text in parts of about limit characters; a part without a safe boundary is longer."""
    out, start = [], 0
    while len(text) - start > limit:
        at = start + limit
        while (at := text.find(" ", at)) > 0 and (text[at - 1].isspace() or text[at + 1 : at + 2].isspace() or at + 1 == len(text)):
            at += 1
        if at < 0:
            break
        out.append(text[start:at])
        start = at
    return [*out, text[start:]]


def lengths_with(kind: str, model: bytes):
    """A function from texts to token counts; whether long texts may be cut."""
    if kind == "json":
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(model.decode())
        tokenizer.no_truncation()
        tokenizer.no_padding()
        state = (tokenizer.pre_tokenizer, tokenizer.normalizer)
        spaced = any(x.lstrip or x.rstrip or any(c.isspace() for c in x.content) for x in tokenizer.get_added_tokens_decoder().values())
        cut = type(state[0]).__name__ == "ByteLevel" and not state[0].add_prefix_space and state[0].use_regex and state[1] is None and not spaced
        return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], cut
    from sentencepiece import SentencePieceProcessor

    processor = SentencePieceProcessor(model_proto=model)
    return lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)], False


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens and over_limit (more than limit tokens) of every row.

    The vocabulary file is read by the driver and goes to the workers with the function (a few MB, its size is fixed).
    """
    path = Path(tokenizer_path)
    kind, model = {".json": "json", ".model": "model"}[path.suffix], path.read_bytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        lengths, cut = lengths_with(kind, model)
        for batch in batches:
            texts = batch.column(1)
            counts, sizes = [0] * len(texts), [0] * len(texts)
            held: list[tuple[int, str]] = []
            weight = 0
            for row, value in enumerate(texts):
                raw = value.as_buffer()
                if raw is None or not raw.size:
                    continue
                sizes[row] = raw.size
                text = raw.to_pybytes().decode()
                for part in pieces(text) if cut else [text]:
                    held.append((row, part))
                    weight += 3 * len(part) if raw.size != len(text) else len(part)
                    if weight >= ENCODE_BYTES:
                        for (k, _), n in zip(held, lengths([x for _, x in held]), strict=True):
                            counts[k] += n
                        held, weight = [], 0
            for (k, _), n in zip(held, lengths([x for _, x in held]), strict=True):
                counts[k] += n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], names=["id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind_of_id = rows.schema["id"].dataType.simpleString()
    return map_arrow(rows, work, f"id {kind_of_id}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


ship(__name__)
