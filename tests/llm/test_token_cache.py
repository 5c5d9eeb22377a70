import pyarrow as pa

from ledgerloom.llm import token_output


def test_a_task_leaves_one_generation_of_pieces(monkeypatch):
    monkeypatch.setattr(token_output, "CACHED_CHARS", 10)
    path = token_output.tokenizer_file()
    batch = lambda i: pa.RecordBatch.from_arrays([pa.array([i]), pa.array([f"some word{i} and other text{i}"])], ["doc_id", "text"])
    out = list(token_output._encoder_batches(path, 0)(batch(i) for i in range(5)))
    assert len(out) == 5 and token_output.encoder_of(path).known and not token_output.encoder_of(path).before
