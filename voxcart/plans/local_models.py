"""Deterministic stand-in models for tests and demonstrations.

Answers depend on the MD5 of the input only, so a SQL engine can predict them and
a changed prompt shows up as a changed answer.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib

import pyarrow as pa


def digest(text: str) -> str:
    return hashlib.md5(text.encode("utf-8")).hexdigest()


def echo_digest(inputs: list[str], **options) -> list[str]:
    return [digest(text) for text in inputs]


def translation(inputs: list[str], **options) -> list[str]:
    languages = ("en", "fr", "de", "xx")
    return [
        json.dumps(
            {
                "translations": [
                    {
                        "translated_text": f" It&#39;s {d} ",
                        "detected_language_code": f" {languages[int(d[0], 16) // 4]}",
                    }
                ]
            }
        )
        for d in map(digest, inputs)
    ]


def sentiment(inputs: list[str], **options) -> list[str]:
    """Scores from -8 to 7 by the first digit; the last one comes without a score."""
    answers = []
    for d in map(digest, inputs):
        score = int(d[0], 16) - 8
        body = {"magnitude": float(abs(score))} if score == 7 else {
            "score": float(score), "magnitude": float(abs(score))
        }
        answers.append(json.dumps({"document_sentiment": body}))
    return answers


def detected_text(inputs: list[str], **options) -> list[str]:
    return [
        json.dumps({"full_text_annotation": {"text": f"• Page\n{digest(text)}"}})
        for text in inputs
    ]


def sentiment_word(inputs: list[str], **options) -> list[str]:
    words = ("positive", "neutral", "negative")
    return [words[int(digest(text)[0], 16) // 6] for text in inputs]


def persona(inputs: list[str], **options) -> list[str]:
    return [
        json.dumps({"persona_title": f"Title {d[:6]}", "persona_description": f"Text {d}"})
        for d in map(digest, inputs)
    ]


def email(inputs: list[str], **options) -> list[tuple[str, str]]:
    return [
        (json.dumps({"email_english": f"Dear {d}", "email_translated": d[:8]}), "[]")
        for d in map(digest, inputs)
    ]


def resolution(inputs: list[str], **options) -> list[tuple[str, str]]:
    """JSON in a code fence with text around it; one field is no string for some."""
    answers = []
    for d in map(digest, inputs):
        translated = 7 if d[0] == "0" else f"Hello {d[:4]}"
        body = json.dumps(
            {
                "issue_resolution": f"Replace {d}",
                "response_user_language": f"Salut {d[:4]}",
                "response_translated": translated,
            }
        )
        answers.append((f"Here it is:\n```json\n{body}\n```", "[]"))
    return answers


def yes_or_no(inputs: list[str], **options) -> list[str]:
    answers = ("yes", "no", "No.", "maybe")
    return [answers[int(digest(text)[0], 16) // 4] for text in inputs]


def page_text(inputs: list[str], **options) -> list[str]:
    return [f"Page {digest(text)}" for text in inputs]


def length_vector(inputs: list[str], **options) -> list[list[float]]:
    return [[float(len(text)), 0.5] for text in inputs]


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_files(comments: pa.Array) -> pa.Array:
    """PNG files of one grey pixel that carry a comment."""
    head = b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0))
    tail = _chunk(b"IDAT", zlib.compress(b"\x00\x80")) + _chunk(b"IEND", b"")
    return pa.array(
        [head + _chunk(b"tEXt", b"Comment\x00" + c.encode()) + tail for c in comments.to_pylist()],
        pa.binary(),
    )


def png_comment(content: bytes) -> str:
    at = content.index(b"tEXt")
    (size,) = struct.unpack(">I", content[at - 4 : at])
    return content[at + 4 : at + 4 + size].partition(b"\x00")[2].decode()


def image_vector(contents: list[bytes], **options) -> list[list[float]]:
    """1408 numbers from the digest of an image's comment."""
    digests = [digest(png_comment(c)) for c in contents]
    return [[int(d[i % 32], 16) / 16 for i in range(1408)] for d in digests]


def image_text(contents: list[bytes], **options) -> list[str]:
    return detected_text([png_comment(c) for c in contents])
