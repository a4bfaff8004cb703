"""Hidden addresses are found wherever they stand."""

import pytest

from trackloom.llm import pii


@pytest.mark.parametrize("address", ["anna [at] example [dot] com", "firstname.lastname [at] example [dot] com", "anna(at)example(dot)com", "someone [at] longhostname [dot] org"])
def test_at_addresses_at_every_offset(address):
    for shift in range(pii.WINDOW):
        text = ("lorem ipsum dolor sit amet " * 8)[: 100 + shift] + " " + address + " and more words follow here" * 6
        _, every = next(pii.find([text], pii.trained()))
        assert address in [text[a:b] for k, a, b in every if k == "email"], shift
