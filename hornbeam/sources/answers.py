"""Written answers held against expected ones, file by file and row by row, as bytes."""

from __future__ import annotations

import os


def rows(path: str) -> set[bytes]:
    """A file's rows, each without its line feed; the last may lack one."""
    with open(path, "rb") as f:
        return {row.removesuffix(b"\n") for row in f}


def differences(expected: str, got: str, ending: str = ".csv") -> list[str]:
    """What differs between the answer files of two folders; files that are missing, and files too many, do."""
    want, have = ({n for n in os.listdir(folder) if n.endswith(ending)} for folder in (expected, got))
    out = [f"{n}: missing" for n in sorted(want - have)] + [f"{n}: not expected" for n in sorted(have - want)]
    for n in sorted(want & have):
        a, b = rows(os.path.join(expected, n)), rows(os.path.join(got, n))
        out += [f"{n}: {len(a - b)} rows missing, {len(b - a)} not expected"] if a != b else []
    return out
