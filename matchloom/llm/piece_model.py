"""A sentencepiece vocabulary, read through the library, and the parts of a text that its pieces never span."""

from __future__ import annotations

import re
from functools import lru_cache

SPACE = "▁"
#: Marks that may be cut off in front, if no piece joins them to what precedes.
MARKS = ",.;:!?)\n"


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        self.scores = [lib.get_score(i) for i in range(n)]
        self.special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i) for i in range(n)]
        self.id_of = {p: i for i, p in enumerate(self.pieces) if not self.special[i]}
        self.byte_ids = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unk_id, self.begin_id, self.end_id = lib.unk_id(), lib.bos_id(), lib.eos_id()
        self.parts = self._part_pattern()

    def _part_pattern(self) -> re.Pattern:
        """Finds the parts of a normalised text; no piece reaches from one part into the next."""
        longer = [p for p in self.id_of if len(p) > 1]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in longer):
            return re.compile(r"(?s).+")
        marks = set(MARKS)
        while bad := {p[i] for p in longer for i in range(1, len(p)) if p[i] in marks and p[i - 1] not in marks and p[i - 1] != SPACE}:
            marks -= bad
        m = re.escape("".join(sorted(marks)))
        if not marks:
            return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        lone = "\n|" if "\n" in marks and not any("\n" in p for p in longer) else ""
        return re.compile(f"{lone}{SPACE}*[^{SPACE}{m}]+|{SPACE}+(?:[{m}][^{SPACE}]*)?|[{m}][^{SPACE}" + ("\\n" if lone else "") + "]*")

    def normalised(self, text: str) -> str:
        return self.library.normalize(text) if text else ""


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    """One model per worker and path."""
    return PieceModel(path)
