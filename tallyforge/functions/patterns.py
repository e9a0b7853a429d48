"""Ordered text rules, as regular expressions matched without regard to case."""

# Refund reasons, first match wins, notes before message.
REASONS = (
    ("DUPLICATE_OR_FAILED_PAYMENT", r"(charg?ed?\s*twice|do?ub?le?\s*charge|duplicate\s*(pa[ym]ment|txn|refunded)|amou?nt\s*dedu?cted\s*with?ou?t|payment\s*debited|failed\s*or?d(er)?\s*after\s*payment|conf(irmed)?\s*utrs|pg\s*for\s*duplicate)"),
    ("CANCELLED_BEFORE_DISPATCH", r"(cancell?ed\s*before\s*dispatch|cancell?ation\s*requ?e?st|or?d(er)?\s*cancell?ation|cancel\s*or?d(er)?|cancel\s*button)"),
    ("PRICE_OR_PROMO_ADJUSTMENT", r"(cou?pon\s*not\s*appl|di[sc]cou?nt\s*not\s*appl|pro?mo\s*c[od]de?\s*inv?al|price\s*(drop|adjust))"),
    ("RETURN_PICKUP_FAILURE", r"(with?ou?t\s*pick?up|pi?c?k?up\s*(not\s*done|missed|msied)|pkp\s*(not\s*done|missed|msied)|rev(erse)?\s*(pick?up|pkp)\s*pending)"),
    ("RETURN_RECEIVED_QC_PASSED", r"(rev(erse)?\s*(pick?up|pkp)\s*qc|qc\s*(ok|passed|clear)|return\s*re?c?[ei]?[ve]*d|passed\s*qc)"),
    ("REFUND_SERVICE_FAILURE", r"(r?f?n?d|ref?u?n?n?d)\s*(not\s*cred?it|pending|delay|de?elay|reprocess)|refund\s*status\s*on\s*pg|arn\s*shared|still\s*waiting\s*for\s*my\s*refund"),
    ("DAMAGED_IN_TRANSIT", r"(tra?n?sit\s*d[ao]?ma?ge|d[ao]ma?ged?\s*in\s*tra?n?sit|unit\s*r?e?c?[ev]*d\s*d[ao]ma?ged|damage\s*confirmed|photos\s*r?c?[ev]*d)"),
    ("WRONG_ITEM_SHIPPED", r"(in?correct\s*pro?du?ct\s*shipp?ed|wrong\s*i?te?m\s*deliver|wrong\s*vari[ae]nt|wrong\s*colour)"),
    ("NOT_DELIVERED_OR_LOST", r"(or?d(er)?\s*not\s*deliver|shipm?e?nt\s*not\s*r?e?c?[ev]*d|d?l?[iv]*ry\s*delay|lost\s*in\s*tra?n?sit|rto\s*conf|not\s*deliver)"),
    ("PRODUCT_FAULT_IN_WARRANTY", r"(w[ta]?r?ra?nty\s*(claim|buy)|rma\s*status|service\s*cent|repair\s*st?a?tu?s|buy-?back)"),
    ("PRODUCT_FAULT_DOA", r"(not\s*char?ging|no\s*l[ei]d|case\s*dead|unit\s*dead|no\s*power|not\s*discover|pair(ing)?\s*fail|not\s*taking\s*charge|silent|no\s*audio|di?st?ort|cra?ckl|battery\s*dra?in|disconnect|dropout|touch\s*not|unresponsive|strap\s*(broken|damage|pin)|mic\s*(issue|not)|dead\s*on\s*arrival|doa)"),
    ("CUSTOMER_CHANGED_MIND", r"(change\s*of\s*mind|changed?\s*my\s*mind|with?ou?t\s*asking|no\s*longer\s*need|don'?t\s*want)"),
    ("GOODWILL_GESTURE", r"(goodwill|good\s*will|one-?time\s*gesture|courtesy|as\s*a\s*gesture)"),
)

# A refund and a replacement both given, and what rules that out.
DUAL_REMEDY = r"(refund\s*\+\s*replacement|replacement\s*\+\s*refund|both\s*refund\s*(and|&)\s*repl|refund\s*(and|&)\s*replacement\s*(both|given)|rfnd\s*\+\s*rplc|replacement\s*dispatched|new\s*unit\s*(also\s*)?(going|sent|shipped)|fresh\s*unit\s*shipped|dispatched\s*a\s*new\s*one|new\s*set)"
NO_DUAL_REMEDY = r"(replacement\s*not\s*applicable|rplc\s*(request\s*)?rejected|replacement\s*(request\s*)?rejected|explained\s*policy,?\s*(refund|rfnd)\s*only|replacement\s*declined|opted\s*for\s*(a\s*)?refund|out\s*of\s*stock|did\s*not\s*want\s*replacement|offered\s*earlier)"

# What the labelling rubric reads in notes, word for word and without regard to case.
RUBRIC_DUAL = (
    "refund + replacement both", "both refund and replacement", "both refund & replacement", "full refund issued and replacement dispatched",
    "credited full amount, new unit", "amount returned to card; fresh unit", "reversed the payment and dispatched a new one",
)
RUBRIC_NOT_DUAL = (
    "replacement not applicable", "explained policy, refund only", "explained policy, rfnd only", "rplc request rejected", "replacement request rejected", "replacement declined",
)
RUBRIC_NO_RETURN = ("without pickup as goodwill", "rfnd processed without pickup")

# Intents of a message, first match wins.
INTENTS = (
    ("refund_status", r"\b(where is my refund|refund not (credited|received)|refund (status|pending|delay)|still waiting for my refund|money for the return)\b"),
    ("cancellation", r"\b(cancel|stop the shipment|don'?t ship|do not ship|change of mind|changed my mind)\b"),
    ("refund", r"\b(refund|money back|reverse the payment|return the money|charged twice|double charge|duplicate payment)\b"),
    ("replacement", r"\b(replacement|replace|new unit|exchange)\b"),
    ("warranty", r"\b(warranty|rma|service cent(re|er)|repair)\b"),
    ("delivery", r"\b(not delivered|delivery|shipment|courier|awb|tracking|pickup|pkp)\b"),
    ("billing", r"\b(invoice|gst|payment|deducted|coupon|promo|discount|price)\b"),
    ("account", r"\b(log ?in|login|otp|password|account|address (change|update))\b"),
    ("policy_question", r"\b(what is (the|your)|how long|policy|how many days|am i eligible|do you (offer|allow))\b"),
    ("product_info", r"\b(compatib|does it (work|support)|specification|pre-?sales|which model)\b"),
)
# The policy's sections that belong to an intent, the most telling first, and the one with all refund rules.
INTENT_SECTIONS = {
    "refund": ("5", "6", "10"),
    "refund_status": ("5", "10"),
    "replacement": ("5", "6"),
    "warranty": ("5", "6"),
    "delivery": ("5", "2"),
    "billing": ("5", "4"),
    "cancellation": ("5",),
    "policy_question": ("5", "3", "2", "8"),
    "product_info": ("2",),
    "sla": ("3", "10"),
    "other": ("5", "3", "10"),
}
REFUND_RULES = "5"
CLASSIFICATION_SECTIONS = ("5", "6", "10")
MONEY_INTENTS = ("refund", "billing", "cancellation", "replacement")
#: How orders, tickets and customers are named in the desk's data.
IDENTIFIERS = (r"vr\d{5,}", r"tk-\d+", r"c1\d{5}")


def personal(identifiers: tuple[str, ...] = IDENTIFIERS) -> str:
    """Words that make a message about its writer's own case, or one of the ``identifiers``."""
    return r"\b(my|mine|i (have|had|was|am|ordered|bought|paid)|order [a-z]{0,2}\d" + "".join(f"|{p}" for p in identifiers) + r")\b"


PERSONAL = personal()

# Attempts to steer a model by its input.
FENCE = r"<<<\s*/?\s*UNTRUSTED[^>]*>>>"
INJECTIONS = (
    ("instruction_override", r"\b(ignore|disregard|forget|override)\b[^.\n]{0,40}\b(previous|prior|above|all|your|the)\b[^.\n]{0,25}\b(instruction|prompt|rule|polic|direction|system)"),
    ("role_hijack", r"\b(you are now|act as|pretend to be|from now on you|new persona|roleplay as)\b"),
    ("system_prompt_probe", r"\b(system prompt|developer message|initial instructions|reveal your (prompt|instructions)|what are your instructions)\b"),
    ("authorisation_injection", r"\b(approve|authorise|authorize|issue|release|sanction)\b[^.\n]{0,30}\b(my|this|the)\b[^.\n]{0,20}\b(refund|payment|credit|replacement)\b[^.\n]{0,40}\b(immediately|now|without|no need|bypass|skip)"),
    ("policy_rewrite", r"\b(the )?(new|updated|revised) polic(y|ies)\b[^.\n]{0,30}\b(states|says|allows|permits)\b"),
    ("schema_tamper", r"\b(output|respond|reply|return)\b[^.\n]{0,25}\b(json|schema|format|field)\b[^.\n]{0,30}\b(instead|only|as follows|exactly)"),
    ("delimiter_break", FENCE),
    ("fake_system_turn", r"(^|\n)\s*(system|assistant|developer)\s*[:>]\s*"),
    ("encoded_payload", r"\b(base64|rot13|hex ?decode|decode this)\b"),
)

# Questions that the policy answers by itself, first match wins, with its section.
ANSWERS = (
    ("warranty_period", "5", ("warranty period", "warranty last", "how long is the warranty", "warranty cover")),
    ("first_response", "3", ("first response", "how quickly", "response time", "how soon will you reply")),
    ("dead_on_arrival", "5", ("dead on arrival", "doa", "arrived dead", "faulty on arrival")),
    ("one_remedy", "5", ("refund and replacement", "both refund and", "refund plus replacement")),
    ("transit", "5", ("lost in transit", "damaged in transit", "never arrived", "lost package")),
    ("hours", "2", ("support hours", "are you open", "24x7", "when can i call", "chat hours")),
    ("survey", "8", ("csat", "survey", "rating request", "feedback survey")),
)

# Words that carry no meaning for retrieval.
STOP_WORDS = (
    "the a an and or of to in is are for on by it be as at that this with from not no any all "
    "i my me you your we they was were has have had do does did can will would should please hi hello "
    "sir madam dear team thanks regards order what when how why which who"
).split()
