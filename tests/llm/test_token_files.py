import numpy as np

from tarnfall.llm import token_files
from tarnfall.llm.registry import tokenizer
from tarnfall.llm.shared import shared_dir, write_file

PATH, END = "word_bpe_49k.json", 49407


def test_counts_match_the_library(spark, sf_dir, odd_docs, no_docs):
    """A special token's name in a text is text here: only the separator after a document may be that id."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer(PATH))
    library.no_padding()
    library.no_truncation()
    library.encode_special_tokens = True
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd_docs, no_docs):
        want = sorted((str(r.doc_id), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
        got = sorted((str(r.doc_id), r.n_tokens) for r in token_files.document_token_counts(docs, tokenizer(PATH), END).collect())
        assert got == want


def test_boundaries_across_blocks(spark):
    rng = np.random.default_rng(2)
    folder, files, want = shared_dir(spark, "tokens"), [], []
    for k, (n, closed) in enumerate([(0, True), (40, True), (1, False), (25, False), (0, False)]):
        sizes = rng.integers(0, 30, n).tolist() if k else [500, 0, 0, 3]
        tokens, start = [], 0
        for i, m in enumerate(sizes):
            is_open = not closed and i == len(sizes) - 1
            if is_open and not m:
                continue
            tokens += [7] * m + ([] if is_open else [END])
            want.append((k, i, start, m, not is_open))
            start += m + 1
        uri = f"{folder}/{k}.bin"
        files.append((uri, write_file(uri, [np.array(tokens, "<u2").tobytes()])))
    table = spark.createDataFrame(files, "file string, bytes long")
    name = {f: k for k, (f, _) in enumerate(files)}
    for block in (2, 6, 64, 4096):
        got = sorted((name[r.file], r.ordinal, r.start, r.n_tokens, r.closed) for r in token_files.count_tokens(table, END, block).collect())
        assert got == sorted(want), block


def test_ids_that_do_not_fit(spark, odd_docs):
    import numpy as np
    import pytest

    assert token_files.stored(np.array([0, 65535])).tolist() == [0, 65535]
    for ids in ([65536], [-1]):
        with pytest.raises(ValueError):
            token_files.stored(np.array(ids))
    with pytest.raises(ValueError):
        token_files.write_token_files(odd_docs, "none", "none", 70_000)
