"""What calls into well-known modules do: module to hint type and label.

Fixed values, in their natural order. "db" and "file" are refined by the member that is called.
"""

# Modules.
MODULES = {
    "fs": ("file", "fs"), "fs-extra": ("file", "fs-extra"), "graceful-fs": ("file", "graceful-fs"), "chokidar": ("file_io", "chokidar"), "glob": ("file_io", "glob"), "fast-glob": ("file_io", "fast-glob"), "tmp": ("file_io", "tmp"),
    "http": ("network_call", "node_http"), "https": ("network_call", "node_http"), "http2": ("network_call", "node_http"), "net": ("network_call", "node_net"), "tls": ("network_call", "node_tls"), "dgram": ("network_call", "node_dgram"), "dns": ("network_call", "node_dns"),
    "undici": ("network_call", "undici"), "axios": ("network_call", "axios"), "node-fetch": ("network_call", "node-fetch"), "got": ("network_call", "got"), "ky": ("network_call", "ky"), "superagent": ("network_call", "superagent"), "ws": ("network_call", "websocket"),
    "socket.io": ("network_call", "socket.io"), "socket.io-client": ("network_call", "socket.io"), "nodemailer": ("network_call", "nodemailer"), "stripe": ("network_call", "stripe"), "twilio": ("network_call", "twilio"), "@sendgrid/mail": ("network_call", "sendgrid"),
    "openai": ("network_call", "openai"), "@anthropic-ai/sdk": ("network_call", "anthropic"), "@aws-sdk/client-s3": ("network_call", "aws-s3"), "@aws-sdk/client-dynamodb": ("db", "dynamodb"), "@octokit/rest": ("network_call", "github"),
    "pg": ("db", "pg"), "pg-pool": ("db", "pg"), "mysql": ("db", "mysql"), "mysql2": ("db", "mysql"), "sqlite3": ("db", "sqlite"), "better-sqlite3": ("db", "sqlite"), "knex": ("db", "knex"), "@prisma/client": ("db", "prisma"), "typeorm": ("db", "typeorm"),
    "sequelize": ("db", "sequelize"), "mongodb": ("db", "mongodb"), "mongoose": ("db", "mongoose"), "drizzle-orm": ("db", "drizzle"), "kysely": ("db", "kysely"), "firebase": ("db", "firebase"), "firebase-admin": ("db", "firebase"), "@supabase/supabase-js": ("db", "supabase"),
    "redis": ("cache_op", "redis"), "ioredis": ("cache_op", "redis"), "memcached": ("cache_op", "memcached"), "keyv": ("cache_op", "keyv"), "node-cache": ("cache_op", "node-cache"),
    "child_process": ("concurrency", "child_process"), "execa": ("concurrency", "execa"), "cross-spawn": ("concurrency", "spawn"), "worker_threads": ("concurrency", "worker_threads"), "cluster": ("concurrency", "cluster"),
    "jsonwebtoken": ("auth_check", "jwt"), "bcrypt": ("auth_check", "bcrypt"), "bcryptjs": ("auth_check", "bcrypt"), "argon2": ("auth_check", "argon2"), "passport": ("auth_check", "passport"),
    "zod": ("validation", "zod"), "joi": ("validation", "joi"), "yup": ("validation", "yup"), "ajv": ("validation", "ajv"),
    "winston": ("logging", "winston"), "pino": ("logging", "pino"), "bunyan": ("logging", "bunyan"), "log4js": ("logging", "log4js"), "debug": ("logging", "debug"),
}
# Globals.
GLOBALS = {
    "fetch": ("network_call", "fetch"), "WebSocket": ("network_call", "websocket"), "XMLHttpRequest": ("network_call", "xhr"), "EventSource": ("network_call", "event_source"),
    "localStorage": ("cache_op", "web_storage"), "sessionStorage": ("cache_op", "web_storage"), "indexedDB": ("db_read", "indexeddb"),
}
# Verbs.
DB_READ = "(?i)^(find|get|select|count|aggregate|list|first|head|search|scan|fetch|read|load|peek|exists|has|distinct|pluck|raw)"
DB_WRITE = "(?i)^(insert|update|delete|save|create|upsert|destroy|remove|write|set|add|push|put|patch|truncate|drop|increment|decrement|bulk|batch|merge|replace)"
FILE_READ = "(?i)^(read|stat|lstat|fstat|access|exists|opendir|readdir|realpath|watch|createReadStream|glob)"
FILE_WRITE = "(?i)^(write|append|mkdir|rm|rmdir|unlink|rename|copy|chmod|chown|truncate|link|symlink|utimes|createWriteStream|open)"
SQL_WRITE = r"(?i)^\s*(insert|update|delete|create|drop|alter|truncate|merge|grant|revoke)\b"
SQL_TXN = r"(?i)^\s*(begin|commit|rollback|start\s+transaction|savepoint)\b"
SQL_READ = r"(?i)^\s*(select|with|show|explain)\b"
