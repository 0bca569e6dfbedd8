"""Nothing outside the subpackage of training-data operators imports it."""

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_rest_does_not_import_the_subpackage():
    files = [p for p in (ROOT / "rankloom").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]
    assert files and not [p for p in files if re.search(r"rankloom\.llm|from \.+llm|import llm", p.read_text())]
