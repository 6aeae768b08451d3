"""Token ids of a public byte-level BPE vocabulary inside tasks."""

from __future__ import annotations

import base64
import functools
import json
import os
import re

#: The vocabulary as tokenizers reads it; beside it lies the same vocabulary as ranks, for tiktoken.
VOCABULARY = "byte_bpe_50k.json"
#: White space of this length goes to tokenizers: tiktoken's pattern engine gives up on somewhat more than 500 000 characters, by a panic.
BLANK = 10_000
LONG_BLANK = re.compile(rf"(?:^|\S)\s{{{BLANK}}}")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def encoder(path: str):
    """A function from a list of texts to their lists of ids.

    Where the vocabulary also lies beside ``path`` as ranks, tiktoken merges (same ids, a
    fraction of the time); tokenizers takes texts that hold the string of a special token, which is that token's id, or
    very long white space, and everything where there are no ranks. Each Python worker keeps one encoder.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"

    @functools.cache
    def whole():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    ranks = f"{os.path.splitext(path)[0]}.tiktoken"
    if not os.path.exists(ranks):
        return lambda texts: [x.ids for x in whole().encode_batch(texts, add_special_tokens=False)]

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        special = [t["content"] for t in json.load(file)["added_tokens"]]
    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def plain(text: str) -> bool:
        return not any(s in text for s in special) and not (len(text) >= BLANK and LONG_BLANK.search(text))

    def run(texts: list[str]) -> list[list[int]]:
        return [fast.encode_ordinary(text) if plain(text) else whole().encode(text, add_special_tokens=False).ids for text in texts]

    return run
