"""Text predicates and normalization of ledger entries."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Patterns of secrets, links, lures, short links and of people who ask.
SEED = r"\b(skey|shss|spup|sEd)[1-9A-HJ-NP-Za-km-z]{16,}\b"
URL = r"(?i)(https?://|www\.)[^\s\"'<>]+"
LURE = r"(?i)\b(airdrop|giveaway|free[\s-]*token|freecoin)\b"
CLAIM = r"(?i)\b(claim|verify)\b[\s\S]{0,28}?\b(account|wallet|token|seed|passphrase|recovery|airdrop|reward|prize|bonus)\b"
SHORT_LINK = r"(?i)\b(bit\.ly|t\.co|tinyurl\.com|goo\.gl|is\.gd|cutt\.ly|rb\.gy|rebrand\.ly)\b"
ASKING = r"(?i)\b(ist das echt|ist das sicher|is this legit|is this real|is this scam|is it safe|scam\?|fake\?|echt\?)\b"

#: Transaction types by category.
CATEGORIES = {
    "payment": ["Payment"],
    "escrow": ["EscrowCreate", "EscrowFinish", "EscrowCancel"],
    "check": ["CheckCreate", "CheckCash", "CheckCancel", "PaymentChannelCreate", "PaymentChannelFund", "PaymentChannelClaim"],
    "market": ["TrustSet", "Clawback", "OfferCreate", "OfferCancel", "AMMCreate", "AMMDeposit", "AMMWithdraw", "AMMVote", "AMMBid", "AMMDelete", "AMMClawback", "MPTokenIssuanceCreate", "MPTokenIssuanceDestroy", "MPTokenIssuanceAuthorize", "MPTokenIssuanceSet"],
    "nft": ["NFTokenMint", "NFTokenBurn", "NFTokenCreateOffer", "NFTokenCancelOffer", "NFTokenAcceptOffer", "NFTokenModify"],
    "admin": [
        "AccountSet", "AccountDelete", "SetRegularKey", "SignerListSet", "TicketCreate", "DepositPreauth", "DIDSet", "DIDDelete", "CredentialCreate", "CredentialAccept", "CredentialDelete", "PermissionedDomainSet",
        "PermissionedDomainDelete", "XChainCreateBridge", "XChainCreateClaimID", "XChainCommit", "XChainClaim", "XChainAccountCreateCommit", "XChainAddClaimAttestation", "XChainAddAccountCreateAttestation", "XChainModifyBridge",
        "OracleSet", "OracleDelete", "VaultCreate", "VaultDeposit", "VaultWithdraw", "VaultSet", "VaultDelete", "VaultClawback", "Batch", "DelegateSet", "LedgerStateFix", "EnableAmendment", "SetFee", "UNLModify",
    ],
}


def lured(text: Column) -> Column:
    return text.rlike(URL) & (text.rlike(LURE) | text.rlike(CLAIM))


def phishing(text: Column) -> Column:
    """malicious, suspect (somebody asks about it), or null: a message with a secret, or with a lure and a link."""
    hit = text.rlike(SEED) | lured(text)
    return F.when(hit & text.rlike(ASKING), "suspect").when(hit, "malicious")


def phishing_uri(text: Column) -> Column:
    return F.coalesce(text.rlike(SHORT_LINK) | lured(text), F.lit(False))


def tx_category(kind: Column) -> Column:
    known = F.create_map(*(F.lit(x) for name, types in CATEGORIES.items() for t in types for x in (t, name)))
    return F.coalesce(F.try_element_at(known, kind), F.lit("other"))


def normal_tag(raw: Column) -> Column:
    """A destination tag: an unsigned 32-bit number, also as digits; 0 is a tag, anything else null."""
    n = F.when(raw.cast("string").rlike(r"^\d{1,10}$"), raw.cast("string").try_cast("bigint"))
    return F.when(n.between(0, 4294967295), n)


def decoded_hex(raw: Column) -> Column:
    """Hex of UTF-8 bytes as text, invalid bytes replaced; null if it is no hex."""
    return F.when(raw.rlike("^([0-9A-Fa-f]{2})*$"), F.make_valid_utf8(F.unhex(raw).cast("string")))


def address_hash(address: Column) -> Column:
    return F.sha2(address, 256)


def protected(text: Column, names: dict[str, str]) -> Column:
    """text with every protected address replaced by its label."""
    for address, label in names.items():
        text = F.replace(text, F.lit(address), F.lit(label))
    return text
