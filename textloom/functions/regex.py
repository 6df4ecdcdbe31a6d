"""Patterns of configurations in Java's dialect."""

import re

#: Code point ranges that stand for the pictographs Java does not know by name.
PICTOGRAPHS = r"\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F900}-\x{1F9FF}\x{1FA70}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B50}\x{2B55}\x{231A}\x{231B}\x{23E9}-\x{23FA}\x{A9}\x{AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{3030}\x{303D}"


def java_pattern(pattern: str) -> str:
    """pattern for Java: any case of any script, code points by number, pictographs as ranges."""
    pattern = re.sub(r"\\U([0-9A-Fa-f]{8})", lambda m: rf"\x{{{int(m[1], 16):X}}}", pattern)
    pattern = re.sub(r"\\p\{(?:Extended_Pictographic|Emoji|IsEmoji)\}", lambda m: f"[{PICTOGRAPHS}]", pattern)
    # Java's back references in any case misread characters beyond 16 bits, so those of pictographs, which have no case, are exact.
    flags = "(?uU)" if PICTOGRAPHS in pattern and re.search(r"\\[1-9]", pattern) else "(?iuU)"
    return flags + pattern if pattern else r"(?!)"
