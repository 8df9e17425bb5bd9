"""Fixed records and their Avro bodies, made with the Java Avro library."""

CLICK = {
    "event_id": "event_1",
    "user_id": "user_8",
    "session_id": "s1",
    "url": "/a",
    "event_type": "click",
    "device": "mobile",
    "referrer": "https://r.example/",
    "timestamp": 1704067207179,
}
CLICK_BODY = bytes.fromhex(
    "0e6576656e745f310c757365725f38047331042f610a636c69636b0c6d6f62696c65"
    "2468747470733a2f2f722e6578616d706c652f96c090a59863"
)
USER_EVENT = {
    "timestamp": 1704067207179,
    "user_id": 1000,
    "session_id": "s1",
    "event_type": "view",
    "page": "/a",
    "referrer": "r",
    "user_agent": "ua",
}
USER_EVENT_BODY = bytes.fromhex("96c090a59863d00f0473310876696577042f610272047561")
USER_EVENT_V3 = USER_EVENT | {"user_process": "bypass-process", "route": None}
USER_EVENT_V3_BODY = bytes.fromhex(
    "96c090a59863d00f0473310876696577042f610272047561021c6279706173732d70726f6365737300"
)
LETTER = {
    "error": "bad",
    "raw_payload": "b'\\x00'",
    "topic": "base-topic",
    "partition": 3,
    "offset": 42,
    "timestamp": 1704067207179,
}
LETTER_BODY = bytes.fromhex("066261640e62275c7830302714626173652d746f706963065496c090a59863")


def framed(body: bytes, writer_id: int = 7) -> bytes:
    return b"\x00" + writer_id.to_bytes(4, "big") + body
