"""Framework patterns of effects: pattern, languages (empty: all), effects as (kind, descriptor).

Fixed values, in their natural order. They are matched in code without literals and comments.
"""

# Fixed values.
EFFECT_PATTERNS = (
    (r"(?i)\.(findOne|findMany|findById|findAll|selectFrom|query|aggregate)\s*\(", (), (("reads", "db.query"),)),
    (r"(?i)\.(save|insert|create|upsert|bulkCreate|insertMany)\b", (), (("writes", "db.write"),)),
    (r"(?i)\.(update|updateOne|updateMany|increment|decrement)\b", (), (("writes", "db.update"),)),
    (r"(?i)\.(delete|destroy|remove|deleteOne|deleteMany|truncate)\b", (), (("writes", "db.delete"),)),
    (r"(?i)\.(transaction|beginTransaction|startTransaction)\b", (), (("writes", "db.transaction"), ("acquires_lock", "db.transaction_lock"),)),
    (r"(?i)\b(fetch|axios|got|superagent)\s*[.(]", (), (("calls_external", "network.http"),)),
    (r"(?i)\b(axios|http|https|fetch|got|superagent|request|client|api|restClient|httpClient)\.(get|post|put|patch|delete)\s*\(", (), (("calls_external", "network.http"),)),
    (r"(?i)\b(requests)\.(get|post|put|patch|delete|head|options)\s*\(", ("python",), (("calls_external", "network.http"),)),
    (r"(?i)\b(HttpClient|RestTemplate|OkHttpClient|WebClient)\.(get|post|put|patch|delete)\s*\(", ("java", "csharp", "kotlin",), (("calls_external", "network.http"),)),
    (r"(?i)\breqwest::Client\b.*\.(get|post|put|patch|delete)\s*\(", ("rust",), (("calls_external", "network.http"),)),
    (r"(?i)\.(emit|publish|dispatch|send|broadcast|trigger)\b", (), (("emits", "event.generic"),)),
    (r"(?i)\b(EventEmitter|PubSub|MessageQueue|kafka|rabbitmq|sns|sqs)\b", (), (("emits", "event.messaging"),)),
    (r"(?i)\bfs\.(readFile|readFileSync|readdir|readdirSync|stat|statSync|access)\b", (), (("reads", "file.read"),)),
    (r"(?i)\bfs\.(writeFile|writeFileSync|appendFile|mkdir|mkdirSync|unlink|rename|copyFile)\b", (), (("writes", "file.write"), ("opens", "file.path"),)),
    (r"(?i)\bcreateReadStream\b", (), (("opens", "file.stream.read"),)),
    (r"(?i)\bcreateWriteStream\b", (), (("opens", "file.stream.write"), ("writes", "file.stream"),)),
    (r"(?i)\bredis\.(get|mget|hget|hgetall|lrange|smembers)\b", (), (("reads", "cache.redis.read"),)),
    (r"(?i)\bredis\.(set|mset|hset|lpush|rpush|sadd|del|expire|incr|decr)\b", (), (("writes", "cache.redis.write"),)),
    (r"(?i)\b(console|logger|log)\.(log|info|warn|error|debug|trace|fatal)\b", (), (("logs", "log.generic"),)),
    (r"(?i)\b(authenticate|authorize|verifyToken|checkPermission|requireRole|guardRoute)\b", (), (("requires", "auth.check"),)),
    (r"(?i)\b(jwt|passport|session)\.(verify|sign|authenticate|decode)\b", (), (("requires", "auth.token"),)),
    (r"(?i)\b(mutex|semaphore|lock|acquire|acquireLock)\b", (), (("acquires_lock", "concurrency.lock"),)),
    (r"(?i)\b(validate|sanitize|normalize|trim|toLowerCase|toUpperCase|slugify)\b", (), (("normalizes", "data.normalize"),)),
    (r"(?i)\bstripe\.\w+[\w.]*\s*\(", (), (("calls_external", "network.stripe"),)),
    (r"(?i)\b(twilio|sendgrid|mailgun|ses)\.\w+[\w.]*\s*\(", (), (("calls_external", "network.email_sms"),)),
    (r"(?i)\b(s3|gcs|cloudStorage)\.\w+[\w.]*\s*\(|\bazure\.storage\b", (), (("calls_external", "network.cloud_storage"),)),
    (r"\btokio::(spawn|block_on|select!)\b", ("rust",), (("calls_external", "runtime.tokio"),)),
    (r"\breqwest::(get|Client)\b", ("rust",), (("calls_external", "network.reqwest"),)),
    (r"\bstd::fs::", ("rust",), (("opens", "file.rust_fs"),)),
    (r"\bFile::(open|create)\b", ("rust",), (("opens", "file.rust_file"),)),
    (r"(?i)\b(diesel|sqlx|sea_orm)::.*(select|find|load|get)\b", ("rust",), (("reads", "db.rust_orm_read"),)),
    (r"(?i)\b(diesel|sqlx|sea_orm)::.*(insert|update|delete|execute)\b", ("rust",), (("writes", "db.rust_orm_write"),)),
    (r"\bArc::(new|clone)\b", ("rust",), (("mutates", "state.arc_shared"),)),
    (r"\bMutex::(new|lock)\b", ("rust",), (("acquires_lock", "concurrency.mutex"),)),
    (r"\bRwLock::(new|read|write)\b", ("rust",), (("acquires_lock", "concurrency.rwlock"),)),
    (r"\bunsafe\s*\{", ("rust",), (("mutates", "state.unsafe_block"),)),
    (r"\bpanic!\b", ("rust",), (("throws", "error.panic"),)),
    (r"\b\.unwrap\(\)", ("rust",), (("throws", "error.unwrap_panic"),)),
    (r"\bserde(_json)?::(to_string|from_str|serialize|deserialize)\b", ("rust",), (("normalizes", "data.serde"),)),
    (r"\btracing::(info|warn|error|debug|trace)!?\b", ("rust",), (("logs", "log.tracing"),)),
    (r"\blog::(info|warn|error|debug|trace)!?\b", ("rust",), (("logs", "log.rust_log"),)),
    (r"\b(JdbcTemplate|NamedParameterJdbcTemplate)\.(query|queryForObject|queryForList)\b", ("java",), (("reads", "db.jdbc_read"),)),
    (r"\b(JdbcTemplate|NamedParameterJdbcTemplate)\.(update|batchUpdate|execute)\b", ("java",), (("writes", "db.jdbc_write"),)),
    (r"\bEntityManager\.(find|createQuery|createNamedQuery|getReference)\b", ("java",), (("reads", "db.jpa_read"),)),
    (r"\bEntityManager\.(persist|merge|remove|flush)\b", ("java",), (("writes", "db.jpa_write"),)),
    (r"\b(HttpClient|OkHttpClient|RestTemplate|WebClient)\b", ("java",), (("calls_external", "network.java_http"),)),
    (r"\bFiles\.(read|write|copy|move|delete|walk|list|newInputStream|newOutputStream)\b", ("java",), (("opens", "file.java_nio"),)),
    (r"\b(FileInputStream|FileOutputStream|BufferedReader|BufferedWriter)\b", ("java",), (("opens", "file.java_io"),)),
    (r"\bsynchronized\b", ("java",), (("acquires_lock", "concurrency.java_synchronized"),)),
    (r"\b(ReentrantLock|StampedLock|CountDownLatch|Semaphore)\b", ("java",), (("acquires_lock", "concurrency.java_lock"),)),
    (r"\b@Transactional\b", ("java",), (("writes", "db.transaction"), ("acquires_lock", "db.transaction_lock"),)),
    (r"\bLogger\.(info|warn|error|debug|trace)\b", ("java",), (("logs", "log.java_logger"),)),
    (r"\bDbContext\b", ("csharp",), (("reads", "db.ef_context"),)),
    (r"\b(DbSet|IQueryable)\.(Where|Select|Include|FirstOrDefault|ToList|Any|Count)\b", ("csharp",), (("reads", "db.ef_read"),)),
    (r"\b(SaveChanges|SaveChangesAsync|Add|Remove|Update)\b", ("csharp",), (("writes", "db.ef_write"),)),
    (r"\bHttpClient\.(GetAsync|PostAsync|PutAsync|DeleteAsync|SendAsync)\b", ("csharp",), (("calls_external", "network.csharp_http"),)),
    (r"\b(File|Directory)\.(Read|Write|Create|Delete|Move|Copy|Exists)\b", ("csharp",), (("opens", "file.csharp_io"),)),
    (r"\block\s*\(", ("csharp",), (("acquires_lock", "concurrency.csharp_lock"),)),
    (r"\b(SemaphoreSlim|Monitor|Mutex)\b", ("csharp",), (("acquires_lock", "concurrency.csharp_sync"),)),
    (r"(?i)\bILogger\.(Log|Info|Warn|Error|Debug|Trace)\b", ("csharp",), (("logs", "log.csharp_ilogger"),)),
    (r"\b(ActiveRecord|ApplicationRecord)", ("ruby",), (("reads", "db.activerecord"),)),
    (r"\.(where|find|find_by|pluck|select|joins|includes|eager_load)\b", ("ruby",), (("reads", "db.ar_read"),)),
    (r"\.(create|update|destroy|save|delete|insert)\b", ("ruby",), (("writes", "db.ar_write"),)),
    (r"\b(Net::HTTP|HTTParty|Faraday|RestClient)\b", ("ruby",), (("calls_external", "network.ruby_http"),)),
    (r"\bFile\.(open|read|write|delete)\b", ("ruby",), (("opens", "file.ruby_io"),)),
    (r"\bRails\.cache\b", ("ruby",), (("reads", "cache.rails"),)),
    (r"\bRedis\b", ("ruby",), (("reads", "cache.redis"),)),
    (r"\braise\s+\w", ("ruby",), (("throws", "error.ruby_raise"),)),
    (r"\bRails\.logger\b", ("ruby",), (("logs", "log.rails"),)),
    (r"\bhttp\.(Get|Post|Head|NewRequest)\b", ("go",), (("calls_external", "network.go_http"),)),
    (r"\bsql\.(Open|DB)\b", ("go",), (("reads", "db.go_sql"),)),
    (r"\bos\.(Open|Create|Remove|Mkdir)\b", ("go",), (("opens", "file.go_os"),)),
    (r"\bsync\.(Mutex|RWMutex|WaitGroup)\b", ("go",), (("acquires_lock", "concurrency.go_sync"),)),
    (r"\bgo\s+\w+\(", ("go",), (("calls_external", "runtime.goroutine"),)),
    (r"\b(log|slog)\.(Print|Fatal|Panic|Info|Warn|Error|Debug)\b", ("go",), (("logs", "log.go"),)),
    (r"\bstd::thread\b", ("cpp",), (("calls_external", "runtime.cpp_thread"),)),
    (r"\bstd::(mutex|shared_mutex|lock_guard|unique_lock)\b", ("cpp",), (("acquires_lock", "concurrency.cpp_mutex"),)),
    (r"\bstd::(ifstream|ofstream|fstream)\b", ("cpp",), (("opens", "file.cpp_fstream"),)),
    (r"\bboost::asio\b", ("cpp",), (("calls_external", "network.boost_asio"),)),
    (r"\bstd::cout\b", ("cpp",), (("logs", "log.cpp_cout"),)),
    (r"\bstd::cerr\b", ("cpp",), (("logs", "log.cpp_cerr"),)),
)
