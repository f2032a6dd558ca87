"""Encryption of columns, keys from passwords, one-time codes, and who may do what.

Values are AES-256-GCM as base64 of nonce, text and tag, in the JVM. Keys are derived once, by the driver.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import os
import struct
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ITERATIONS, ADMIN_ITERATIONS, SALT = 100_000, 200_000, 16


def derive_key(password: str, salt: bytes, iterations: int = ITERATIONS) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, iterations, 32)


def new_salt() -> bytes:
    return os.urandom(SALT)


def encrypt(value: Column, key: bytes) -> Column:
    """base64; null for null."""
    return F.base64(F.aes_encrypt(F.encode(value, "UTF-8"), F.lit(key), F.lit("GCM")))


def decrypt(value: Column, key: bytes) -> Column:
    """The text; null where the key is wrong or the value damaged."""
    return F.decode(F.try_aes_decrypt(F.try_to_binary(value, F.lit("base64")), F.lit(key), F.lit("GCM")), "UTF-8")


def encrypt_with_password(value: Column, password: str, salt: bytes | None = None) -> Column:
    """base64 of the salt and the encrypted value."""
    salt = salt or new_salt()
    return F.base64(F.concat(F.lit(salt), F.unbase64(encrypt(value, derive_key(password, salt)))))


def decrypt_with_password(value: Column, password: str) -> Column:
    """Values of any salt, which each carries; null where the password is wrong or the value damaged. Only deriving the
    key needs Python, once a salt and worker; the password isn't part of the plan."""

    @F.pandas_udf("binary")
    def key_of(salts: pd.Series) -> pd.Series:
        known = {s: derive_key(password, bytes(s)) for s in salts.dropna().unique()}
        return salts.map(known).astype(object).where(salts.notna(), None)

    raw = F.try_to_binary(value, F.lit("base64"))
    salt = F.when(F.length(raw) > SALT, F.substr(raw, F.lit(1), F.lit(SALT)))
    rest = F.when(F.length(raw) > SALT, F.substr(raw, F.lit(SALT + 1)))
    return F.decode(F.try_aes_decrypt(rest, key_of(salt), F.lit("GCM")), "UTF-8")


def totp(secret: str, at: int, digits: int = 6, period: int = 30) -> str:
    """The code at a time in seconds."""
    key = base64.b32decode(secret.upper() + "=" * (-len(secret) % 8))
    mac = hmac.new(key, struct.pack(">Q", at // period), hashlib.sha1).digest()
    start = mac[-1] & 15
    return str((int.from_bytes(mac[start : start + 4], "big") & 0x7FFFFFFF) % 10**digits).zfill(digits)


def totp_codes(secret: Column, at: Column) -> Column:
    """Codes of a column of secrets at a column of times."""

    @F.pandas_udf("string")
    def code(secrets: pd.Series, times: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or pd.isna(t) or t < 0 else totp(s, int(t)) for s, t in zip(secrets, times, strict=True)], dtype=object)

    return code(secret, at)


def totp_valid(secret: Column, code: Column, at: Column, window: int = 1, period: int = 30) -> Column:
    """Whether a code is that of the time or of ``window`` periods around it."""
    return F.coalesce(code.isin(*[totp_codes(secret, at + d * period) for d in range(-window, window + 1)]), F.lit(False))


def totp_uri(secret: str, account: str, issuer: str) -> str:
    return f"otpauth://totp/{quote(issuer)}:{quote(account)}?secret={secret}&issuer={quote(issuer)}&algorithm=SHA1&digits=6&period=30"


def needs_auth(verified_at: Column, ttl_days: Column, now: Column) -> Column:
    """Whether a cached key has to be verified again: -1 never, 0 always, else after so many days."""
    return F.when(ttl_days == -1, F.lit(False)).when(verified_at.isNull() | (ttl_days == 0), F.lit(True)).otherwise(now >= verified_at + F.make_interval(days=ttl_days))


def auth_text(method: Column, biometric: Column, ttl_days: Column) -> Column:
    """How values are protected, in words."""
    how = F.when(method == "password", "Password").when(method == "totp", "Authenticator app").otherwise("None")
    ttl = F.when(ttl_days == -1, "never asks again").when(ttl_days == 0, "asks every time").otherwise(F.concat(F.lit("asks every "), ttl_days.cast("string"), F.lit(" days")))
    return F.concat_ws(", ", how, F.when(biometric, "biometric unlock"), ttl)


#: Actions that an administrator's password protects.
PROTECTED = ("disable", "changeOrgPolicy", "removeOrgPolicy", "exportData", "resetAll")


def admin_hash(password: str, salt: bytes) -> str:
    return base64.b64encode(derive_key(password, salt, ADMIN_ITERATIONS)).decode()


def may(action: str, password: str | None, salt: bytes | None, stored: str | None, policy_forbids_disabling: bool = False) -> bool:
    """Whether an action is allowed: unprotected ones and those without a stored hash are, others with the password.
    A policy can forbid disabling whatever the password."""
    if action == "disable" and policy_forbids_disabling:
        return False
    if action not in PROTECTED or not stored or salt is None:
        return True
    return password is not None and hmac.compare_digest(admin_hash(password, salt), stored)
