"""Seeded texts full of identifiers, near misses and Unicode noise. Secret shapes are put together here."""

import random

WORDS = ["müşteri", "hesap", "İSTANBUL", "ığdır", "vergi no:", "VKN", "TC", "t.c.", "kimlik no", "cep", "kart", "🙂", "naïve", "…", "½",
         "proje", "Anka", "Ankara", "password:", "parola =", "şifre:", "e-posta", "[TCKN_1]", "2024-01-31", "12/05/2024", "no", "\n", "tckn no"]


def make_tckn(rnd):
    d = [rnd.randint(1, 9)] + [rnd.randint(0, 9) for _ in range(8)]
    d.append((7 * sum(d[::2]) - sum(d[1::2])) % 10)
    return "".join(map(str, d + [sum(d) % 10]))


def make_card(rnd):
    d = [4] + [rnd.randint(0, 9) for _ in range(14)]
    total = sum(sum(divmod(2 * x, 10)) if i % 2 == 0 else x for i, x in enumerate(reversed(d)))
    return "".join(map(str, d + [-total % 10]))


def make_iban(rnd):
    bban = "".join(str(rnd.randint(0, 9)) for _ in range(22))
    return f"TR{98 - int(bban + '292700') % 97:02d}{bban}"


def grouped(value, size, sep=" "):
    return sep.join(value[i:i + size] for i in range(0, len(value), size))


def value(rnd):
    t, c, b = make_tckn(rnd), make_card(rnd), make_iban(rnd)
    letters = "ABCDEFGHJKLMNPQRSTUVWXYZ0123456789"
    word = "".join(rnd.choice(letters) for _ in range(40))
    return rnd.choice([
        t, grouped(t, 3), grouped(t, 3, "."), grouped(t, 3, "-"), t[:5] + "​" + t[5:], t.translate(str.maketrans("0123456789", "０１２３４５６７８９")),
        t[:-1], str(int(t) + 1), c, grouped(c, 4), grouped(c, 4, "-"), b, grouped(b, 4), b.lower(), b[:-1],
        f"0{rnd.randint(500, 559)} {rnd.randint(100, 999)} {rnd.randint(10, 99)} {rnd.randint(10, 99)}", f"+90{rnd.randint(5000000000, 5599999999)}",
        f"kisi{rnd.randint(1, 99)}@ornek.com.tr", f"a.b+c@x-{rnd.randint(1, 9)}.org-", "34 ABC 123", "06ÇA12", "82 AB 1234",
        "AK" + "IA" + word[:16], "sk-" + "ant-" + word[:24], "sk-" + "proj-" + word[:22], "xox" + "b-" + word[:12], "gh" + "p_" + word[:36],
        "eyJ" + word[:12] + ".eyJ" + word[12:24] + "." + word[24:36], "postgres" + "://u:" + word[:6] + "@h/db", word[:9] + ";", "hunter22x", "${DB_PASSWORD}",
        "vergi no: " + "".join(str(rnd.randint(0, 9)) for _ in range(10)), "-----BEGIN " + "PRIVATE KEY-----\n" + word[:8],
        "aws_secret_access_key" + " = " + word[:40], "\x01", "é", "１２３", "①"])


def text(rnd, size=14):
    return " ".join(rnd.choice([rnd.choice(WORDS), value(rnd)]) for _ in range(rnd.randint(1, size)))


def parts(seed):
    """Texts whose neighbours may share a value cut in two. A key block without its end is left out: it
    runs to the end of whatever text it is scanned in."""
    rnd = random.Random(seed)
    out = [text(rnd).replace("PRIVATE KEY-----", "KEY") if rnd.random() < 0.9 else "" for _ in range(rnd.randint(1, 6))]
    for i in range(1, len(out)):
        if rnd.random() < 0.5:
            v = value(rnd).replace("PRIVATE KEY-----", "KEY")
            cut = rnd.randint(1, max(1, len(v) - 1))
            out[i - 1], out[i] = f"{out[i - 1]} {v[:cut]}", f"{v[cut:]} {out[i]}"
    return out
