"""Typed error rows from Terraform output, by native expressions.

Stages are separate projections, so that what several fields need of a block is matched once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Titles of configuration and workflow errors with the code they stand for, in the order tried.
CONFIG_ERRORS = {
    "invalid default value": "InvalidDefaultValue",
    "no value for required variable": "MissingRequiredVariable",
    "unsupported argument": "UnsupportedArgument",
    "missing required argument": "MissingRequiredArgument",
    "reference to undeclared": "UndeclaredReference",
    "inconsistent dependency lock file": "InconsistentLockFile",
    "module not installed": "ModuleNotInstalled",
    "failed to query available provider packages": "ProviderQueryFailed",
    "invalid value for input variable": "InvalidInputVariable",
    "this object does not have an attribute": "UndeclaredAttribute",
}
#: Codes of errors before any resource is read.
INIT_CODES = ["InconsistentLockFile", "ModuleNotInstalled", "ProviderQueryFailed"]
#: Known error codes of two clouds.
AWS_CODES = """AccessDenied AccessDeniedException UnauthorizedAccess BucketAlreadyExists BucketAlreadyOwnedByYou
InvalidParameterValue InvalidParameterCombination ResourceNotFoundException ResourceInUseException LimitExceeded QuotaExceeded
ServiceQuotaExceededException ValidationException ValidationError InvalidAMIID InvalidSubnet InvalidVpcID
InsufficientInstanceCapacity InstanceLimitExceeded DBInstanceNotFound DBSubnetGroupDoesNotCoverEnoughAZs StorageQuotaExceeded
InvalidDBInstanceState""".split()
AZURE_CODES = """AuthorizationFailed AuthenticationFailed StorageAccountAlreadyTaken StorageAccountNotFound SkuNotAvailable
QuotaExceeded ResourceNotFound ResourceGroupNotFound ConflictError Conflict InvalidParameter BadRequest PrincipalNotFound
RoleAssignmentExists""".split()
#: Blocks of a configuration that an error may lie in.
SCOPES = ["variable", "local", "output", "module"]
#: Patterns that tell a provider, tried in this order.
PROVIDER_PATTERNS = [
    ("aws", r"(?i)\baws_[a-z_]+\b"),
    ("azure", r"(?i)\bazurerm_[a-z_]+\b"),
    ("gcp", r"(?i)\bgoogle_[a-z_]+\b"),
    ("aws", r"(?i)arn:aws:|amazonaws\.com|aws-sdk|ec2:|s3:|iam:|lambda:"),
    ("azure", r"(?i)azure\.com|microsoft\.com|\.azure\.|subscription.*resource\s*group"),
    ("gcp", r"(?i)googleapis\.com|gcloud|projects/[^/]+/"),
]
#: Advice by provider and code.
ADVICE = [
    ("aws", ["AccessDenied", "AccessDeniedException"], ["Check IAM permissions for the Terraform execution role", "Verify the resource policy allows the action"]),
    ("aws", ["BucketAlreadyExists"], ["S3 bucket names are globally unique - use a different name", "Add a random suffix to the bucket name"]),
    ("aws", "Quota|Limit", ["Request a service quota increase via AWS Support", "Check current usage in AWS Service Quotas console"]),
    ("aws", ["InvalidAMIID"], ["Verify the AMI exists in the target region", "Check if the AMI is shared with your account"]),
    ("aws", "Insufficient(Instance)?Capacity", ["Try a different availability zone", "Try a different instance type"]),
    ("azure", ["AuthorizationFailed", "AuthenticationFailed"], ["Check Azure RBAC role assignments", "Verify service principal credentials"]),
    ("azure", ["StorageAccountAlreadyTaken"], ["Storage account names are globally unique - use a different name"]),
    ("azure", ["SkuNotAvailable"], ["Check VM size availability in the target region", "Try a different region or VM size"]),
    ("azure", ["ConflictError"], ["Recover or purge the soft-deleted resource", "Use az keyvault purge or az keyvault recover"]),
]
#: Patterns of a resource's address, tried in this order (see ``resource``).
WITH = r"(?i)with\s+((?:module\.[a-z0-9_-]+\.)*([a-z][a-z0-9_]*)\.([-a-z0-9_]+))"
NAMED = r"(?i)\b((?:aws|azurerm|google)_[a-z0-9_]+)\.([a-z0-9_-]+)\b"
DEFINED = r'(?i)in\s+resource\s+"((?:aws|azurerm|google)_[a-z0-9_]+)"\s+"([a-z0-9_-]+)"'
DOING = r"(?i)(?:creating|updating|deleting)\s+([A-Za-z0-9_\s]+)\s*\(([^)]+)\)"
MESSAGE = "(?s)Message:\\s*[\"']?(.+?)[\"']?(?:\\n│|\\n\\n|\\n?\\z)"


def known_codes(codes: list[str]) -> list[str]:
    """Codes in the order they are looked for: of two that a text holds, the longer counts, then the first by name."""
    return sorted(codes, key=lambda c: (-len(c), c))


def got(text: Column, pattern: str, group: int = 1) -> Column:
    """What a group of the first match holds; null if there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def one_line(c: Column, length: int = 500) -> Column:
    """Text with runs of white space as one blank, none at the ends, cut at ``length``."""
    return F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, length)


def first_of_each(items: Column, key) -> Column:  # noqa: ANN001
    """The items of an array whose key did not occur before."""
    keys = F.transform(items, key)
    return F.filter(items, lambda e, i: F.array_position(keys, key(e)) == i + 1)


def error_blocks(text: Column) -> Column:
    """The ``Error:`` blocks of an output, each different one once, in order."""
    parts = F.filter(F.split(text, r"(?=│?\s*Error:)"), lambda b: b.contains("Error:") & (F.length(b) > 6))
    return first_of_each(parts, lambda b: F.regexp_replace(b, r"^\s+|\s+\z", ""))


def resource(block: Column) -> Column:
    """address, type, name of the resource that a block is about, as a struct; ``unknown`` where none is named."""
    clean = F.regexp_replace(block, "│", "")

    def found(pattern: str, address: Column, kind: Column, name: Column) -> Column:
        return F.when(clean.rlike(pattern), F.struct(address.alias("address"), kind.alias("type"), name.alias("name")))

    dotted = lambda kind, name: F.concat(kind, F.lit("."), name)
    pair = lambda pattern: (F.regexp_extract(clean, pattern, 1), F.regexp_extract(clean, pattern, 2))
    named, defined = pair(NAMED), pair(DEFINED)
    doing = F.lower(F.replace(F.regexp_replace(F.regexp_extract(clean, DOING, 1), r"^\s+|\s+\z", ""), F.lit(" "), F.lit("_")))
    done = F.regexp_replace(F.regexp_extract(clean, DOING, 2), r"^\s+|\s+\z", "")
    scopes = [found(f'in {s} "([a-zA-Z0-9_-]+)"', F.concat(F.lit(f"{s}."), F.regexp_extract(clean, f'in {s} "([a-zA-Z0-9_-]+)"', 1)), F.lit(s), F.regexp_extract(clean, f'in {s} "([a-zA-Z0-9_-]+)"', 1)) for s in SCOPES]
    three = lambda a, t, n: F.struct(F.lit(a).alias("address"), F.lit(t).alias("type"), F.lit(n).alias("name"))
    return F.coalesce(
        found(WITH, F.regexp_extract(clean, WITH, 1), F.regexp_extract(clean, WITH, 2), F.regexp_extract(clean, WITH, 3)),
        found(NAMED, dotted(*named), *named),
        found(DEFINED, dotted(*defined), *defined),
        found(DOING, dotted(doing, done), doing, done),
        *scopes,
        F.when(config_code(clean).isin(INIT_CODES), three("terraform.init", "terraform", "init")),
        three("unknown", "unknown", "unknown"),
    )


def config_code(text: Column) -> Column:
    """The code that the title of a configuration error stands for; null for other titles."""
    title = F.lower(F.regexp_extract(text, r"Error:\s*([^\n]+)", 1))
    return F.coalesce(*[F.when(title.contains(part), F.lit(code)) for part, code in CONFIG_ERRORS.items()])


def error_code(block: Column) -> Column:
    """A block's error code by the first rule that holds: named, API error, known code, status, title."""
    return F.coalesce(
        got(block, "Code:\\s*[\"']?([A-Za-z][A-Za-z0-9_]+)[\"']?"),
        got(block, r"(?i)api\s+error\s+([A-Za-z][A-Za-z0-9_]+):"),
        *[F.when(block.contains(c), F.lit(c)) for codes in (AWS_CODES, AZURE_CODES) for c in known_codes(codes)],
        F.replace(got(block, r"Status:\s*(\d+\s*[A-Za-z]+)"), F.lit(" "), F.lit("")),
        got(block, r"StatusCode:\s*(\d+)"),
        config_code(block),
    )


def cloud(block: Column, kind: Column) -> Column:
    """The provider by the resource's type, else by what the text names."""
    typed = F.when(kind.startswith("aws_"), "aws").when(kind.startswith("azurerm_"), "azure").when(kind.startswith("google_"), "gcp")
    return F.coalesce(typed, *[F.when(block.rlike(p), F.lit(name)) for name, p in PROVIDER_PATTERNS], F.lit("unknown"))


def message(block: Column) -> Column:
    """The ``Message:`` field, else the block's first line."""
    first = F.regexp_replace(F.substring_index(block, "\n", 1), r"^│?\s*Error:\s*", "")
    whole = F.trim(F.regexp_replace(F.coalesce(got(block, MESSAGE), first), r"\s+", " "))
    return F.substring(F.regexp_replace(whole, r"^│\s*", ""), 1, 500)


def advice(provider: Column, code: Column, text: Column) -> Column:
    """What to try, by provider and code; an empty array where nothing is known."""
    rules = []
    for name, codes, tips in ADVICE:
        fits = code.rlike(codes) if isinstance(codes, str) else code.isin(codes)
        if codes == ["ConflictError"]:
            fits = fits & F.lower(text).contains("soft")
        rules.append(F.when((provider == name) & fits, F.array(*map(F.lit, tips))))
    return F.coalesce(*rules, F.array().cast("array<string>"))


def action(block: Column) -> Column:
    """What was being done: create, update or delete; null if the text does not say."""
    words = [("create", "(?i)creating"), ("update", "(?i)updating|modifying"), ("delete", "(?i)deleting|destroying")]
    return F.coalesce(*[F.when(block.rlike(p), F.lit(a)) for a, p in words])


def parse_terraform(df: DataFrame, text: str) -> DataFrame:
    """The error rows of Terraform outputs: the other columns of ``df``, ``error_no`` (from 1) and an error's fields.

    Null texts and texts without an error have no rows; a column of ``df`` named like a field is replaced.
    """
    b = F.col("raw_output")
    keep = [c for c in df.columns if c != text]
    rows = df.select(*keep, F.posexplode(error_blocks(F.col(text))).alias("__at", "__block"))
    rows = rows.withColumn("raw_output", F.col("__block")).withColumn("__r", resource(b)).withColumn("error_code", error_code(b)).withColumn("error_message", message(b))
    rows = rows.withColumn("cloud_provider", cloud(b, F.col("__r.type")))
    listed = F.array_compact(F.array(F.lit("terraform"), F.when(F.col("cloud_provider") != "unknown", F.col("cloud_provider")), F.when(F.col("__r.type") != "unknown", F.col("__r.type")), F.col("error_code")))
    fields = {
        "error_no": (F.col("__at") + 1).cast("int"),
        "error_type": F.lit("terraform"),
        "error_message": F.col("error_message"),
        "raw_output": b,
        "resource_type": F.col("__r.type"),
        "resource_name": F.col("__r.name"),
        "resource_address": F.col("__r.address"),
        "file": got(b, r"on\s+([^\s]+\.tf)\s+line\s+\d+"),
        "line": got(b, r"on\s+[^\s]+\.tf\s+line\s+(\d+)").cast("int"),
        "error_code": F.col("error_code"),
        "cloud_provider": F.col("cloud_provider"),
        "severity": F.lit("error"),
        "suggestions": advice(F.col("cloud_provider"), F.col("error_code"), F.col("error_message")),
        "tags": listed,
        "terraform_action": action(b),
        "module_path": got(F.col("__r.address"), r"^(module\.[^.]+)"),
    }
    return rows.select(*[c for c in keep if c not in fields], *[v.alias(k) for k, v in fields.items()])


def says_terraform(text: Column) -> Column:
    """Whether a text looks like Terraform output."""
    return reduce(lambda a, c: a | c, [text.rlike(p) for p in TERRAFORM_SIGNS])


#: What Terraform output looks like.
TERRAFORM_SIGNS = [rf"(?i){p}" for p in (r"Error:", r"│\s*Error:", r"aws_\w+\.", r"azurerm_\w+\.", r"google_\w+\.", r"\.tf\s+line\s+\d+", r"with\s+\w+\.\w+", r"Plan:.*to add.*to change.*to destroy", r"terraform\s+(init|plan|apply)")]
