"""Result, request and answer JSON for test cases."""

import base64
import json

PNG = base64.b64encode("\x89PNG fake image bytes".encode("latin-1")).decode()
PDF = base64.b64encode(b"%PDF-1.4 test").decode()
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
REDACTED = "iVBORredactedPNG"
HIT, MISS = "MATCH_FOUND", "NO_MATCH_FOUND"


def state(match=MISS, ran=True):
    return {"executionState": "EXECUTION_SUCCESS" if ran else "EXECUTION_SKIPPED", "matchState": match}


def result(hits=(), invocation="SUCCESS", skipped=(), redacted=None, wrapped=True, rai_type="dangerous"):
    """A screening result with the named filters matched and the named filters not run."""
    s = lambda name: state(HIT if name in hits else MISS, name not in skipped and "all" not in skipped)
    rai = {**s("rai"), "raiFilterTypeResults": {rai_type: {"matchState": HIT if "rai" in hits else MISS}}}
    if redacted is None:
        sdp = {"inspectResult": s("sdp")}
    else:
        types = ["PHONE_NUMBER", "EMAIL_ADDRESS", "PHONE_NUMBER"] if "sdp" in hits else []
        sdp = {"redactResult": {**s("sdp"), "redactedImage": redacted, "extractedImageText": "SECRET OCR",
                                "findings": [{"infoType": t if i else {"name": t}} for i, t in enumerate(types)]}}
    body = {
        "filterMatchState": HIT if hits else MISS, "invocationResult": invocation,
        "filterResults": {
            "csam": {"csamFilterFilterResult": s("csam")},
            "malicious_uris": {"maliciousUriFilterResult": s("malicious_uris")},
            "rai": {"raiFilterResult": rai},
            "pi_and_jailbreak": {"piAndJailbreakFilterResult": s("pi_and_jailbreak")},
            "sdp": {"sdpFilterResult": sdp},
        },
    }
    return json.dumps({"sanitizationResult": body} if wrapped else body)


def request(parts, role="user", **extra):
    content = {"parts": parts} if role is None else {"role": role, "parts": parts}
    return json.dumps({**extra, "contents": [content]})


def file(mime, data=PNG):
    return {"inlineData": {"mimeType": mime, "data": data}}


def answer(parts):
    return json.dumps({"candidates": [{"content": {"role": "model", "parts": parts}}], "usageMetadata": {"totalTokenCount": 9}})
