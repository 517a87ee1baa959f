"""How far the bytes behind a match look like what its signature promises."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from pyspark.sql import DataFrame

from tracehound.operators import profiles
from tracehound.operators.profiles import shannon

#: What a score looks at, at most, from the match on.
REACH = 16384
SAMPLE = 256


def _marked(window: bytes, least: int, any_of: list[tuple[bool, float]]) -> float:
    """The score of the first condition that holds; 0.5 for windows too short to say."""
    return 0.5 if len(window) <= least else next(score for holds, score in any_of if holds)


def structure(signature_id: str, data: bytes, hit: int, broad: bool = False) -> float:
    """0.45 where nothing is known of the format. broad: 0.85 of it, 0.2 at least."""
    w = data[hit : hit + REACH]
    if signature_id in ("sig-common-0001", "sig-common-0002"):
        score = _marked(w[:512], 4, [(b"\xff\xd9" in w[:512], 0.92), (True, 0.68)])
    elif signature_id == "sig-common-0003":
        score = _marked(w[:4096], 8, [(b"IEND\xaeB`\x82" in w[:4096], 0.95), (True, 0.74)])
    elif signature_id == "sig-common-0009":
        low = w[:8192].lower()
        body, end = b" obj\n" in low, b"xref" in low or b"%%eof" in low
        score = _marked(low, 4, [(body and end, 0.96), (body, 0.78), (True, 0.58)])
    elif "zip" in signature_id or "docx" in signature_id:
        member, listing = b"PK\x03\x04" in w, b"PK\x01\x02" in w or b"PK\x05\x06" in w
        score = _marked(w, 4, [(member and listing, 0.93), (member, 0.72), (True, 0.55)])
    elif any(x in signature_id for x in ("vmdk", "vhd", "qcow")):
        score = _marked(w[:128], 8, [(w[:128].count(0) / max(len(w[:128]), 1) > 0.15, 0.88), (True, 0.69)])
    else:
        score = 0.45
    return max(0.85 * score, 0.2) if broad else score


def learned(signature_id: str, data: bytes, hit: int) -> float:
    """Score of the first 256 bytes by entropy and share of text."""
    prior = 0.15 if "pdf" in signature_id or "sql" in signature_id else 0.1 if "jpg" in signature_id or "png" in signature_id else 0.05
    return _sampled(np.frombuffer(data, np.uint8)[hit : hit + SAMPLE], prior)


def _sampled(sample: np.ndarray, prior: float) -> float:
    if not len(sample):
        return 0.0
    text = float((((sample >= 32) & (sample <= 126)) | (sample == 10) | (sample == 13)).mean())
    texture = min(max(0.6 * text + 0.4 * (1 - abs(text - 0.45)), 0), 1)
    return min(max(0.55 * min(shannon(sample) / 8, 1) + 0.35 * texture + prior, 0), 1)


def samples(evidence: DataFrame, prior: float) -> DataFrame:
    """source_path, score of the first 256 bytes; 0 where there are none."""
    return profiles._per_source(evidence, "source_path string, score double", lambda d: [(_sampled(d[:SAMPLE], prior),)])


#: What scores the bytes behind a match, 0 to 1: signature id, data, place of the match.
Classifier = Callable[[str, bytes, int], float]


def blended(signature_id: str, data: bytes, hit: int, broad: bool = False, classifier: Classifier = learned) -> tuple[float, float]:
    """Validation score and confidence."""
    v = min(max(0.7 * structure(signature_id, data, hit, broad) + 0.3 * classifier(signature_id, data, hit), 0), 1)
    return v, round(min(0.62 + 0.38 * v, 0.99) + 1e-9, 2)
