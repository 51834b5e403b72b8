"""Rules that read contracts off code: group, gate, pattern, expression, strength, source type.

Fixed values, in their natural order. In an expression {1} is the pattern's first group and
{2:60} its second, squeezed and cut to 60 characters. Repeats inside brackets are possessive,
so that long code can't make the matcher back up. A gate is a language, or the beginning of
"library:" followed by substrings of which the body must have one.
"""

# Building blocks.
_NUMBER = r"(-?\d+(?:\.\d+)?)"
_REGEX = r"(\/(?:[^/\\]|\\.)+\/[gimsuy]*)"
_COMPARE = r"(<|>|<=|>=)"
_EMPTY = r"(?:null|undefined|false|0|''|\"\"|``)"
_CONDITION = rf"if\s*\(\s*(![\w.\[\]?]+|[\w.\[\]?]+\s*(?:===?|!==?)\s*{_EMPTY})\s*\)\s*\{{?\s*"
#: What stands between balanced parentheses, three deep.
BALANCED = r"((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+)\)"
_ZOD = "library:z.string|z.number|z.boolean|z.object|z.enum|z.array"
_YUP = "library:yup.string|yup.number|yup.boolean|yup.object"
_JOI = "library:Joi.string|Joi.number|Joi.boolean|Joi.object"

# The rules.
BODY_RULES = (
    ("P6a", "", r"\bassert\s*\(" + BALANCED, "assert:{1:120}", 0.90, "assertion"),
    ("P6a", "", r"\bconsole\s*\.\s*assert\s*\(" + BALANCED, "console_assert:{1:120}", 0.85, "assertion"),
    ("P6a", "", r"\binvariant\s*\(" + BALANCED, "invariant_call:{1:120}", 0.92, "assertion"),
    ("P6a", "", r"\bprecondition\s*\(" + BALANCED, "precondition:{1:120}", 0.93, "assertion"),
    ("P6b", "", _CONDITION + r"throw\b", "guard_clause:{1:120} => throw", 0.88, "assertion"),
    ("P6b", "", _CONDITION + r"return\b", "guard_clause:{1:120} => early_return", 0.75, "assertion"),
    ("P6c", "", r"typeof\s+([\w.]+)\s*(?:===?|!==?)\s*['\"](string|number|boolean|function|object|undefined|bigint|symbol)['\"]", "type_guard:typeof {1} === '{2}'", 0.82, "assertion"),
    ("P6c", "", r"([\w.]+)\s+instanceof\s+([\w.]+)", "type_guard:{1} instanceof {2}", 0.82, "assertion"),
    ("P6c", "", r"Array\s*\.\s*isArray\s*\(\s*([\w.]+)\s*\)", "type_guard:Array.isArray({1})", 0.82, "assertion"),
    ("P6c", "", r"(?:Number\s*\.\s*)?isNaN\s*\(\s*([\w.]+)\s*\)", "type_guard:isNaN({1}) checked", 0.78, "assertion"),
    ("P6c", "", r"(?:Number\s*\.\s*)?isFinite\s*\(\s*([\w.]+)\s*\)", "type_guard:isFinite({1}) checked", 0.78, "assertion"),
    ("P6d", "", r"([\w.]+)\s*\?\?\s*([^;,\n]+)", "null_safety:{1} has nullish fallback {2:60}", 0.72, "assertion"),
    ("P6d", "", r"([\w.]+)\s*\?\.\s*([\w.]+)", "null_safety:{1} optional-chained to {2}", 0.68, "assertion"),
    ("P6d", "", r"if\s*\(\s*([\w.]+)\s*(?:!==?|===?)\s*(?:null|undefined)\s*\)", "null_check:{1} explicitly checked against null/undefined", 0.80, "assertion"),
    ("P6d", "", r"if\s*\(\s*([\w.]+)\s*(?:!=)\s*(?:null)\s*\)", "null_check:{1} loosely checked (covers null + undefined)", 0.80, "assertion"),
    ("P6e", "", rf"Math\s*\.\s*max\s*\(\s*{_NUMBER}\s*,\s*Math\s*\.\s*min\s*\(\s*{_NUMBER}\s*,\s*([\w.]+)\s*\)\s*\)", "range_clamp:{3} clamped to [{1}, {2}]", 0.88, "assertion"),
    ("P6e", "", rf"if\s*\(\s*([\w.]+)\s*{_COMPARE}\s*{_NUMBER}\s*(?:\|\||&&)\s*\1\s*{_COMPARE}\s*{_NUMBER}\s*\)", "range_check:{1} {2} {3} and {1} {4} {5}", 0.85, "assertion"),
    ("P6e", "", rf"Math\s*\.\s*max\s*\(\s*{_NUMBER}\s*,\s*([\w.]+)\s*\)", "range_lower_bound:{2} >= {1} (clamped)", 0.83, "assertion"),
    ("P6e", "", rf"Math\s*\.\s*min\s*\(\s*{_NUMBER}\s*,\s*([\w.]+)\s*\)", "range_upper_bound:{2} <= {1} (clamped)", 0.83, "assertion"),
    ("P6e", "", rf"if\s*\(\s*([\w.]+)\s*{_COMPARE}\s*{_NUMBER}\s*\)", "boundary_check:{1} {2} {3}", 0.78, "assertion"),
    ("P6e", "", r"if\s*\(\s*([\w.]+)\s*\.\s*length\s*(<|>|<=|>=|===?|!==?)\s*(\d+)\s*\)", "length_check:{1}.length {2} {3}", 0.80, "assertion"),
    ("P6g", "", r"\[\s*([^\]]+)\s*\]\s*\.\s*includes\s*\(\s*([\w.]+)\s*\)", "enum_restriction:{2} in [{1:80}]", 0.82, "assertion"),
    ("P6h", "", r"([\w.]+)\s*\.\s*trim\s*\(\s*\)", "normalization:{1} is trimmed", 0.70, "derived"),
    ("P6h", "", r"([\w.]+)\s*\.\s*toLowerCase\s*\(\s*\)", "normalization:{1} is lowercased", 0.70, "derived"),
    ("P6h", "", r"([\w.]+)\s*\.\s*toUpperCase\s*\(\s*\)", "normalization:{1} is uppercased", 0.70, "derived"),
    ("P6h", "", r"([\w.]+)\s*\.\s*replace\s*\(\s*(\/(?:[^/\\]|\\.)+\/[gimsuy]*|['\"][^'\"]*['\"])\s*,", "normalization:{1} undergoes replace({2:60})", 0.68, "derived"),
    ("P6h", "", r"parseInt\s*\(\s*([\w.]+)\s*(?:,\s*\d+)?\s*\)", "normalization:{1} parsed as integer", 0.72, "derived"),
    ("P6h", "", r"parseFloat\s*\(\s*([\w.]+)\s*\)", "normalization:{1} parsed as float", 0.72, "derived"),
    ("P6h", "", r"Number\s*\(\s*([\w.]+)\s*\)", "normalization:{1} coerced to Number", 0.72, "derived"),
    ("P6h", "", r"JSON\s*\.\s*parse\s*\(\s*([\w.]+)\s*\)", "deserialization:{1} is JSON-parsed (may throw SyntaxError)", 0.75, "derived"),
    ("P6i", "", r"@Column\s*\(\s*\{[^}]*type\s*:\s*['\"](\w+)['\"][^}]*\}\s*\)", "schema_orm:TypeORM column type={1}", 0.90, "schema"),
    ("P6i", "", r"@Column\s*\(\s*\{(?=[^}]*type\s*:\s*['\"]\w)[^}]*nullable\s*:\s*false[^}]*\}\s*\)", "schema_orm:column is NOT NULL", 0.92, "schema"),
    ("P6i", "", r"@Column\s*\(\s*\{(?=[^}]*type\s*:\s*['\"]\w)[^}]*unique\s*:\s*true[^}]*\}\s*\)", "schema_orm:column is UNIQUE", 0.92, "schema"),
    ("P6i", "", r"@Column\s*\(\s*\{(?=[^}]*type\s*:\s*['\"]\w)[^}]*?length\s*:\s*(\d+)[^}]*\}\s*\)", "schema_orm:column max length={1}", 0.90, "schema"),
    ("P6i", "", r"@Column\s*\(\s*\{(?=[^}]*type\s*:\s*['\"]\w)[^}]*?default\s*:\s*([^,}]+)[^}]*\}\s*\)", "schema_orm:column default={1:60}", 0.85, "schema"),
    ("P6i", "", r"@PrimaryGeneratedColumn\s*\(", "schema_orm:has auto-generated primary key", 0.95, "schema"),
    ("P6i", "", r"@CreateDateColumn\s*\(", "schema_orm:has auto-managed created_at timestamp", 0.90, "schema"),
    ("P6i", "", r"@UpdateDateColumn\s*\(", "schema_orm:has auto-managed updated_at timestamp", 0.90, "schema"),
    ("P6i", "", r"(\w+)\s*:\s*\{\s*type\s*:\s*(String|Number|Boolean|Date|Buffer|ObjectId|Array|Map|Schema\.Types\.\w+)", "schema_mongoose:{1} type={2}", 0.88, "schema"),
    ("P6i", "", r"required\s*:\s*true", "schema_mongoose:has required field(s)", 0.88, "schema"),
    ("P6i", "", r"unique\s*:\s*true", "schema_mongoose:has unique field(s)", 0.88, "schema"),
    ("P6i", "", r"enum\s*:\s*\[([^\]]+)\]", "schema_mongoose:field restricted to enum [{1:80}]", 0.88, "schema"),
    ("P6i", "", rf"min\s*:\s*{_NUMBER}", "schema_mongoose:field min={1}", 0.85, "schema"),
    ("P6i", "", rf"max\s*:\s*{_NUMBER}", "schema_mongoose:field max={1}", 0.85, "schema"),
    ("P6i", "", r"minlength\s*:\s*(\d+)", "schema_mongoose:field minlength={1}", 0.85, "schema"),
    ("P6i", "", r"maxlength\s*:\s*(\d+)", "schema_mongoose:field maxlength={1}", 0.85, "schema"),
    ("P6i", "", rf"match\s*:\s*{_REGEX}", "schema_mongoose:field must match {1:80}", 0.85, "schema"),
    ("P6j", _ZOD, r"z\s*\.\s*string\s*\(\s*\)", "schema_zod:validates string type", 0.88, "schema"),
    ("P6j", _ZOD, r"z\s*\.\s*number\s*\(\s*\)", "schema_zod:validates number type", 0.88, "schema"),
    ("P6j", _ZOD, r"z\s*\.\s*boolean\s*\(\s*\)", "schema_zod:validates boolean type", 0.88, "schema"),
    ("P6j", _ZOD, r"z\s*\.\s*enum\s*\(\s*\[([^\]]+)\]\s*\)", "schema_zod:enum restricted to [{1:80}]", 0.90, "schema"),
    ("P6j", _ZOD, rf"\.min\s*\(\s*{_NUMBER}\s*\)", "schema_zod:min={1}", 0.87, "schema"),
    ("P6j", _ZOD, rf"\.max\s*\(\s*{_NUMBER}\s*\)", "schema_zod:max={1}", 0.87, "schema"),
    ("P6j", _ZOD, r"\.email\s*\(\s*\)", "schema_zod:validates email format", 0.90, "schema"),
    ("P6j", _ZOD, r"\.url\s*\(\s*\)", "schema_zod:validates URL format", 0.90, "schema"),
    ("P6j", _ZOD, r"\.uuid\s*\(\s*\)", "schema_zod:validates UUID format", 0.90, "schema"),
    ("P6j", _ZOD, rf"\.regex\s*\(\s*{_REGEX}\s*\)", "schema_zod:validates against regex {1:80}", 0.87, "schema"),
    ("P6j", _ZOD, r"\.optional\s*\(\s*\)", "schema_zod:field(s) marked optional", 0.80, "schema"),
    ("P6j", _ZOD, r"\.nullable\s*\(\s*\)", "schema_zod:field(s) marked nullable", 0.80, "schema"),
    ("P6j", _ZOD, r"\.nonnegative\s*\(\s*\)", "schema_zod:number must be non-negative (>= 0)", 0.88, "schema"),
    ("P6j", _ZOD, r"\.positive\s*\(\s*\)", "schema_zod:number must be positive (> 0)", 0.88, "schema"),
    ("P6j", _ZOD, r"\.int\s*\(\s*\)", "schema_zod:number must be integer", 0.88, "schema"),
    ("P6j", _YUP, r"yup\s*\.\s*string\s*\(\s*\)", "schema_yup:validates string type", 0.86, "schema"),
    ("P6j", _YUP, r"yup\s*\.\s*number\s*\(\s*\)", "schema_yup:validates number type", 0.86, "schema"),
    ("P6j", _YUP, r"yup\s*\.\s*boolean\s*\(\s*\)", "schema_yup:validates boolean type", 0.86, "schema"),
    ("P6j", _YUP, r"\.required\s*\(\s*\)", "schema_yup:field(s) marked required", 0.88, "schema"),
    ("P6j", _YUP, r"\.email\s*\(\s*\)", "schema_yup:validates email format", 0.88, "schema"),
    ("P6j", _YUP, r"\.url\s*\(\s*\)", "schema_yup:validates URL format", 0.88, "schema"),
    ("P6j", _YUP, rf"\.min\s*\(\s*{_NUMBER}\s*\)", "schema_yup:min={1}", 0.85, "schema"),
    ("P6j", _YUP, rf"\.max\s*\(\s*{_NUMBER}\s*\)", "schema_yup:max={1}", 0.85, "schema"),
    ("P6j", _JOI, r"Joi\s*\.\s*string\s*\(\s*\)", "schema_joi:validates string type", 0.86, "schema"),
    ("P6j", _JOI, r"Joi\s*\.\s*number\s*\(\s*\)", "schema_joi:validates number type", 0.86, "schema"),
    ("P6j", _JOI, r"Joi\s*\.\s*boolean\s*\(\s*\)", "schema_joi:validates boolean type", 0.86, "schema"),
    ("P6j", _JOI, r"\.required\s*\(\s*\)", "schema_joi:field(s) marked required", 0.88, "schema"),
    ("P6j", _JOI, r"\.email\s*\(\s*\)", "schema_joi:validates email format", 0.88, "schema"),
    ("P6j", _JOI, r"\.uri\s*\(\s*\)", "schema_joi:validates URI format", 0.88, "schema"),
    ("P6j", _JOI, rf"\.min\s*\(\s*{_NUMBER}\s*\)", "schema_joi:min={1}", 0.85, "schema"),
    ("P6j", _JOI, rf"\.max\s*\(\s*{_NUMBER}\s*\)", "schema_joi:max={1}", 0.85, "schema"),
    ("P6j", _JOI, rf"\.pattern\s*\(\s*{_REGEX}\s*\)", "schema_joi:validates against pattern {1:80}", 0.87, "schema"),
    ("P6j", _JOI, r"\.valid\s*\(\s*([^)]+)\s*\)", "schema_joi:valid values restricted to ({1:80})", 0.88, "schema"),
    ("P6k", "", r"=>\s*\(|return\s+function\b|return\s+\([^)]*\)\s*=>", "higher_order:function returns or chains callable", 0.68, "derived"),
    ("P6k", "", r"\bthis\s*\.", "closure_binding:accesses instance state via this", 0.65, "derived"),
    ("P6l", "rust", r"(\S*)\.\s*unwrap\s*\(\s*\)", "rust_unwrap:{1:120}.unwrap() — panics if None/Err", 0.85, "assertion"),
    ("P6l", "rust", r"\.\s*expect\s*\(\s*[\"']([^\"']+)[\"']\s*\)", 'rust_expect:expect("{1:60}")', 0.88, "assertion"),
    ("P6l", "rust", r"panic!\s*\(\s*[\"']([^\"']+)[\"']", 'rust_panic:panic!("{1:60}")', 0.95, "assertion"),
    ("P6l", "rust", r"assert!\s*\(\s*([^)]+)\)", "rust_assert:assert!({1:80})", 0.92, "assertion"),
    ("P6l", "rust", r"assert_eq!\s*\(\s*([^,]+),\s*([^)]+)\)", "rust_assert_eq:assert_eq!({1:40}, {2:40})", 0.92, "assertion"),
    ("P6l", "rust", r"unsafe\s*\{", "rust_unsafe:contains unsafe block — memory safety guarantees relaxed", 0.95, "assertion"),
    ("P6l", "java", r"Objects\s*\.\s*requireNonNull\s*\(\s*([\w.]+)", "java_require_nonnull:{1:60} must not be null", 0.92, "assertion"),
    ("P6l", "java", r"assert\s+([^;:]+)\s*;", "java_assert:assert {1:80}", 0.88, "assertion"),
    ("P6l", "java", r"assert\s+([^;:]+)\s*:\s*[\"']([^\"']+)[\"']\s*;", 'java_assert:assert {1:80} : "{2:40}"', 0.88, "assertion"),
    ("P6l", "java", r"@(?:NotNull|NonNull|Nonnull)\b", "java_annotation:@NotNull — null values rejected", 0.95, "type_constraint"),
    ("P6l", "java", r"(?i)@Pattern\s*\(\s*regexp\s*=\s*[\"']([^\"']+)[\"']\s*\)", "java_pattern_constraint:must match /{1:60}/", 0.93, "type_constraint"),
    ("P6l", "java", r"(?i)@Size\s*\(\s*min\s*=\s*(\d+)\s*,\s*max\s*=\s*(\d+)\s*\)", "java_size_constraint:size in [{1}, {2}]", 0.93, "type_constraint"),
    ("P6l", "java", r"(?i)@Size\s*\(\s*min\s*=\s*(\d+)\s*\)", "java_size_constraint:size in [{1}, unbounded]", 0.93, "type_constraint"),
    ("P6l", "java", r"(?i)@Size\s*\(\s*max\s*=\s*(\d+)\s*\)", "java_size_constraint:size in [0, {1}]", 0.93, "type_constraint"),
    ("P6l", "csharp", r"ArgumentNullException\s*\.\s*ThrowIfNull\s*\(\s*([\w.]+)", "csharp_throw_if_null:{1:60} must not be null", 0.93, "assertion"),
    ("P6l", "csharp", r"\[Required\]", "csharp_required:field marked [Required]", 0.95, "type_constraint"),
    ("P6l", "csharp", r"\[Range\s*\(\s*(-?\d+)\s*,\s*(-?\d+)\s*\)\]", "csharp_range:value in [{1}, {2}]", 0.93, "type_constraint"),
    ("P6l", "csharp", r"\[StringLength\s*\(\s*(\d+)\s*\)\]", "csharp_string_length:length in [0, {1}]", 0.93, "type_constraint"),
    ("P6l", "csharp", r"\[StringLength\s*\(\s*(\d+)\s*,\s*MinimumLength\s*=\s*(\d+)\s*\)\]", "csharp_string_length:length in [{2}, {1}]", 0.93, "type_constraint"),
    ("P6l", "ruby", r"validates\s+:(\w+)\s*,\s*([^\n]+)", "ruby_validates:{1:30} — {2:60}", 0.90, "schema"),
    ("P6l", "ruby", r"validates_presence_of\s+:(\w+)", "ruby_validates_presence:{1:40} must be present", 0.92, "schema"),
    ("P6l", "ruby", r"raise\s+(\w[\w:]*)", "ruby_raise:raises {1:60}", 0.85, "assertion"),
)

# Decorators, matched without regard to case; a pattern's first match counts.
DECORATOR_RULES = (
    (r"@IsEmail\s*\(", "decorator_validation:field must be valid email", 0.92, "assertion"),
    (r"@IsUrl\s*\(", "decorator_validation:field must be valid URL", 0.92, "assertion"),
    (r"@IsUUID\s*\(", "decorator_validation:field must be valid UUID", 0.92, "assertion"),
    (r"@IsInt\s*\(", "decorator_validation:field must be integer", 0.90, "assertion"),
    (r"@IsNumber\s*\(", "decorator_validation:field must be number", 0.90, "assertion"),
    (r"@IsString\s*\(", "decorator_validation:field must be string", 0.90, "assertion"),
    (r"@IsBoolean\s*\(", "decorator_validation:field must be boolean", 0.90, "assertion"),
    (r"@IsDate\s*\(", "decorator_validation:field must be Date", 0.90, "assertion"),
    (r"@IsEnum\s*\(", "decorator_validation:field must be enum value", 0.90, "assertion"),
    (r"@IsNotEmpty\s*\(", "decorator_validation:field must not be empty", 0.90, "assertion"),
    (r"@IsOptional\s*\(", "decorator_validation:field is optional", 0.80, "derived"),
    (r"@IsArray\s*\(", "decorator_validation:field must be array", 0.90, "assertion"),
    (rf"@Min\s*\(\s*{_NUMBER}\s*\)", "decorator_range:min={1}", 0.90, "assertion"),
    (rf"@Max\s*\(\s*{_NUMBER}\s*\)", "decorator_range:max={1}", 0.90, "assertion"),
    (r"@MinLength\s*\(\s*(\d+)\s*\)", "decorator_length:minLength={1}", 0.90, "assertion"),
    (r"@MaxLength\s*\(\s*(\d+)\s*\)", "decorator_length:maxLength={1}", 0.90, "assertion"),
    (r"@Length\s*\(\s*(\d+)\s*\)", "decorator_length:length=[{1}]", 0.90, "assertion"),
    (r"@Length\s*\(\s*(\d+)\s*,\s*(\d+)\s*\)", "decorator_length:length=[{1}, {2}]", 0.90, "assertion"),
    (rf"@Matches\s*\(\s*{_REGEX}\s*\)", "decorator_pattern:must match {1:80}", 0.88, "assertion"),
    (r"@(?:RequiresRole|Roles?|HasRole)\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", "decorator_auth:requires role '{1}'", 0.93, "assertion"),
    (r"@(?:Authenticated|UseGuards|Auth|RequireAuth)\s*\(", "decorator_auth:requires authentication", 0.93, "assertion"),
    (r"@Column\s*\(\s*\{(?![^}]*length\s*:\s*\d)[^}]*?type\s*:\s*['\"](\w+)['\"][^}]*\}\s*\)", "decorator_schema:column type={1}", 0.90, "schema"),
    (r"@Column\s*\(\s*\{[^}]*?type\s*:\s*['\"](\w+)['\"][^}]*?length\s*:\s*(\d+)[^}]*\}\s*\)", "decorator_schema:column type={1} length={2}", 0.90, "schema"),
    (r"@(?:RateLimit|Throttle|RateLimiter)\s*\(\s*(\d+)\s*\)", "decorator_rate_limit:limit={1}", 0.88, "assertion"),
    (r"@(?:RateLimit|Throttle|RateLimiter)\s*\(\s*(\d+)\s*,\s*['\"]([^'\"]+)['\"]\s*\)", "decorator_rate_limit:limit={1} per {2}", 0.88, "assertion"),
    (r"@(?:Validate|ValidateNested|ValidateIf)\s*\(", "decorator_validation:input undergoes validation", 0.85, "assertion"),
)

# What a regular expression in code stands for; the first that fits counts.
REGEX_DOMAINS = (
    (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "email"),
    (r"https?:\/\/[^\s'\"]+", "url"),
    (r"\(\d{3}\)\s*\d{3}-?\d{4}|\d{3}-\d{3}-\d{4}", "phone"),
    (r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "uuid"),
    (r"(?:\d{1,3}\.){3}\d{1,3}", "ipv4"),
    (r"^\^?\[a-z|^\^?\[A-Z", "alpha"),
    (r"^\^?\[0-9|^\^?\\d", "numeric"),
    (r"(?i)date|time|yyyy|mm|dd", "datetime"),
)
