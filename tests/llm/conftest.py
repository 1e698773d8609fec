import os

import pytest

TOKENIZERS = os.environ.get("SFUMATO_TOKENIZERS", "/opt/tokenizers")


@pytest.fixture(scope="session")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t
