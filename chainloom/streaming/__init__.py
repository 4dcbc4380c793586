from chainloom.streaming.jobs import (
    CondenseStore,
    stream_code_check,
    stream_condense,
    stream_reindex,
    stream_token_meter,
    token_meter,
)

__all__ = ["CondenseStore", "stream_code_check", "stream_condense", "stream_reindex", "stream_token_meter", "token_meter"]
