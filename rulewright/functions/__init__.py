"""Column functions: three-valued conditions, canonical values, identity of rules, redaction of texts."""
