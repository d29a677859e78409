import pyarrow as pa
import pyarrow.parquet as pq
import pytest

DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])


@pytest.fixture
def make_docs(tmp_path):
    """Writes texts as a documents table, with columns of clashing names, and gives its folder."""

    def make(texts, langs=None, ids=None, **more):
        n = len(texts)
        table = pa.table(
            {
                "doc_id": list(range(n)) if ids is None else ids,
                "text": texts,
                "lang": langs or [None] * n,
                "source": ["s"] * n,
                "n_chars": [len(t or "") for t in texts],
            },
            DOCS,
        )
        for name in ("ids", "component_id", "text_", "kept", "_key", "lang_pred", "score", "n_gone", "n_lines", "gone", "decoded", "n_tokens", "similarity", "_hash", "_id"):
            table = table.append_column(name, pa.array([7] * n, pa.int32()))
        pq.write_table(table, tmp_path / "documents.parquet")
        for name, columns in more.items():
            pq.write_table(pa.table(columns), tmp_path / f"{name}.parquet")
        return str(tmp_path)

    return make


@pytest.fixture(scope="session")
def sample():
    """Texts of the smallest given documents table."""
    return pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()


