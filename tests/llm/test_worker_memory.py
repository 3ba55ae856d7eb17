"""Python workers give freed memory back."""

from pathlib import Path

from corpuslab.llm import _shared


def resident() -> int:
    return int(Path("/proc/self/statm").read_text().split()[1]) * 4096


def test_freed_memory_goes_back_at_the_end_of_a_task():
    kept = []

    def run(batches):
        held = [bytes(50_000) for _ in range(4000)]
        kept.append(bytes(50_000))  # above what is freed, so that the allocator keeps that
        for batch in batches:
            yield batch, len(held)

    before = resident()
    assert list(_shared.trimmed(run)(iter([1, 2]))) == [(1, 4000), (2, 4000)]
    assert resident() - before < 50_000_000
