import pytest

from quire.llm import secrets


COST = secrets.Guesser().cost


def values(text):
    return [text[s:e] for s, _, e in secrets.cred_spans(text, secrets.STRONG, COST)[0]]


@pytest.mark.parametrize("key", ["AWS_SECRET_ACCESS_KEY=", "SECRET_KEY = ", "access_key: ", "encryption-key=", "secretAccessKey: ", "api_key=", "token_value="])
@pytest.mark.parametrize("quote", ["", "'", '"'])
def test_keys(key, quote):
    assert values(f"x {key}{quote}wJalrXUtn7FEMIK7MDENGbPx{quote} y") == ["wJalrXUtn7FEMIK7MDENGbPx"]


def test_quoted_values_are_taken_whole():
    assert values('password = "aB3,x9Q!z<k;" z') == ["aB3,x9Q!z<k;"]
    assert values("passphrase: 'correct horse \"battery\" staple'") == ['correct horse "battery" staple']
    assert values(r'"secret": "q\"Zx9,Kw2#v"') == [r"q\"Zx9,Kw2#v"]


def test_open_quotes_hide_no_value():
    assert values('token="Zx9$Kw2#vQ\npwd=Xk9$vQ2!zR') == ["Zx9$Kw2#vQ", "Xk9$vQ2!zR"]
    assert "Yk8%Lw3&uP" in values('token="abc token="Yk8%Lw3&uP"')
    assert values("secret" * 3000 + "=") == [] and len(values("token='" * 3000)) < 3000
