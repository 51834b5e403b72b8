"""Line patterns of behaviour hints: pattern, hint type, detail, languages (empty: all).

Fixed values, in their natural order.
"""

# All languages but TypeScript and JavaScript, whose own table follows.
HINT_PATTERNS = (
    (r"\.(findOne|findMany|findAll|findById|findUnique|findFirst)\s*\(", "db_read", "orm_find", ()),
    (r"\.select\s*\(", "db_read", "query_select", ()),
    (r"\.query\s*\(", "db_read", "raw_query", ()),
    (r"\.(getOne|getMany|getAll|getById)\s*\(", "db_read", "db_get", ()),
    (r"\.(persist|saveAll|saveMany)\s*\(", "db_write", "orm_save", ()),
    (r"\.(insertOne|insertMany|bulkInsert|batchInsert)\s*\(", "db_write", "db_insert", ()),
    (r"\.(updateOne|updateMany|updateById|bulkUpdate)\s*\(", "db_write", "db_update", ()),
    (r"\.(deleteOne|deleteMany|deleteById|bulkDelete)\s*\(", "db_write", "db_delete", ()),
    (r"\.(removeOne|removeMany|removeById)\s*\(", "db_write", "db_remove", ()),
    (r"\.(createOne|createMany|bulkCreate)\s*\(", "db_write", "db_create", ()),
    (r"\b(db|DB|repo|repository|model|Model|collection|Collection|table|Table)\.\w*(save|insert|update|delete|remove|create|upsert|destroy)\w*\s*\(", "db_write", "db_contextual_write", ()),
    (r"fetch\s*\(", "network_call", "fetch", ()),
    (r"axios\.(get|post|put|patch|delete)\s*\(", "network_call", "axios", ()),
    (r"\.request\s*\(", "network_call", "http_request", ()),
    (r"https?\.\s*(get|request)\s*\(", "network_call", "node_http", ()),
    (r"WebSocket", "network_call", "websocket", ()),
    (r"fs\.(read|write|append|unlink|mkdir|rmdir)", "file_io", "fs_operation", ()),
    (r"readFile(Sync)?\s*\(", "file_io", "read_file", ()),
    (r"writeFile(Sync)?\s*\(", "file_io", "write_file", ()),
    (r"\bopen\s*\(", "file_io", "file_open", ("python", "ruby",)),
    (r"\.cache\.(get|set|del|clear)", "cache_op", "cache_operation", ()),
    (r"redis\.(get|set|hget|hset|del)", "cache_op", "redis", ()),
    (r"\.authenticate\s*\(", "auth_check", "authenticate", ()),
    (r"\.authorize\s*\(", "auth_check", "authorize", ()),
    (r"verify(Token|JWT|Session)", "auth_check", "token_verify", ()),
    (r"\.isAuthenticated", "auth_check", "auth_check", ()),
    (r"\.validate\s*\(", "validation", "validate", ()),
    (r"Joi\.|Yup\.|Zod\.", "validation", "schema_validation", ()),
    (r"throw\s+new\s+\w+", "throws", "throws", ()),
    (r"raise\s+\w+", "throws", "python_raise", ()),
    (r"catch\s*\(", "catches", "catches", ()),
    (r"except\s+", "catches", "python_except", ()),
    (r"this\.\w+\s*=", "state_mutation", "this_assignment", ()),
    (r"self\.\w+\s*=", "state_mutation", "self_assignment", ()),
    (r"\.setState\s*\(", "state_mutation", "set_state", ()),
    (r"\.transaction\s*\(", "transaction", "db_transaction", ()),
    (r"BEGIN|COMMIT|ROLLBACK", "transaction", "sql_transaction", ()),
    (r"console\.(log|warn|error|info)", "logging", "console", ()),
    (r"log\.(debug|info|warn|error|fatal)", "logging", "structured_log", ()),
    (r"logging\.(debug|info|warn|error)", "logging", "python_logging", ()),
    (r"fmt\.(Print|Println|Printf|Errorf)", "logging", "go_fmt", ()),
    (r"std::cout|std::cerr|fprintf", "logging", "cpp_io", ()),
    (r"tokio::spawn", "concurrency", "tokio_spawn", ("rust",)),
    (r"reqwest::(get|post|put|patch|delete|Client)", "network_call", "reqwest", ("rust",)),
    (r"hyper::(Client|Request|Response)", "network_call", "hyper", ("rust",)),
    (r"std::fs::", "file_io", "rust_fs", ("rust",)),
    (r"File::(open|create)", "file_io", "rust_file", ("rust",)),
    (r"diesel::", "db_read", "diesel", ("rust",)),
    (r"sqlx::", "db_read", "sqlx", ("rust",)),
    (r"sea_orm::", "db_read", "sea_orm", ("rust",)),
    (r"\.execute\s*\(", "db_write", "db_execute", ("rust", "java",)),
    (r"serde_json::", "serialization", "serde_json", ("rust",)),
    (r"serde::", "serialization", "serde", ("rust",)),
    (r"log::(debug|info|warn|error|trace)", "logging", "rust_log", ("rust",)),
    (r"tracing::(debug|info|warn|error|trace|span)", "logging", "rust_tracing", ("rust",)),
    (r"Arc::new", "concurrency", "arc_shared_state", ("rust",)),
    (r"Mutex::(lock|try_lock)", "acquires_lock", "rust_mutex", ("rust",)),
    (r"RwLock::(read|write)", "acquires_lock", "rust_rwlock", ("rust",)),
    (r"panic!", "throws", "rust_panic", ("rust",)),
    (r"\.unwrap\s*\(", "throws", "rust_unwrap", ("rust",)),
    (r"\.expect\s*\(", "throws", "rust_expect", ("rust",)),
    (r"unsafe\s*\{", "state_mutation", "unsafe_block", ("rust",)),
    (r"jdbc|DriverManager\.getConnection", "db_read", "jdbc", ("java",)),
    (r"EntityManager|@PersistenceContext", "db_read", "jpa", ("java",)),
    (r"Hibernate|SessionFactory|Session\.", "db_read", "hibernate", ("java",)),
    (r"MyBatis|SqlSession", "db_read", "mybatis", ("java",)),
    (r"HttpClient\.new", "network_call", "java_httpclient", ("java",)),
    (r"OkHttpClient|okhttp3", "network_call", "okhttp", ("java",)),
    (r"RestTemplate|WebClient", "network_call", "spring_http", ("java",)),
    (r"Files\.(read|write|copy|move|delete|create)", "file_io", "java_nio_files", ("java",)),
    (r"FileInputStream|FileOutputStream|FileReader|FileWriter", "file_io", "java_file_io", ("java",)),
    (r"Jedis|Lettuce|RedisTemplate", "cache_op", "java_redis", ("java",)),
    (r"@Transactional", "transaction", "spring_transactional", ("java",)),
    (r"synchronized\s*\(", "acquires_lock", "java_synchronized", ("java",)),
    (r"ReentrantLock|\.lock\s*\(", "acquires_lock", "java_lock", ("java",)),
    (r"Logger\.(debug|info|warn|error|trace)", "logging", "java_logger", ("java",)),
    (r"LOG\.(debug|info|warn|error|trace)", "logging", "java_LOG", ("java",)),
    (r"throw\s+new\s+", "throws", "java_throw", ("java",)),
    (r"DbContext|DbSet|EntityFramework", "db_read", "ef_core", ("csharp",)),
    (r"\.SaveChanges(Async)?\s*\(", "db_write", "ef_save_changes", ("csharp",)),
    (r"HttpClient\.(Get|Post|Put|Delete|Send)", "network_call", "csharp_httpclient", ("csharp",)),
    (r"WebRequest|HttpWebRequest", "network_call", "csharp_webrequest", ("csharp",)),
    (r"File\.(Read|Write|Open|Create|Delete|Copy|Move)", "file_io", "csharp_file", ("csharp",)),
    (r"Stream(Reader|Writer)", "file_io", "csharp_stream", ("csharp",)),
    (r"lock\s*\(", "acquires_lock", "csharp_lock", ("csharp",)),
    (r"SemaphoreSlim|Monitor\.(Enter|Exit)", "acquires_lock", "csharp_semaphore", ("csharp",)),
    (r"ILogger\.(Log|Debug|Info|Warn|Error)", "logging", "csharp_ilogger", ("csharp",)),
    (r"Debug\.(Write|WriteLine)", "logging", "csharp_debug", ("csharp",)),
    (r"Trace\.(Write|WriteLine)", "logging", "csharp_trace", ("csharp",)),
    (r"ActiveRecord|ApplicationRecord", "db_read", "activerecord", ("ruby",)),
    (r"\.where\s*\(", "db_read", "ar_where", ("ruby",)),
    (r"\.find(_by)?\s*\(", "db_read", "ar_find", ("ruby",)),
    (r"\.create[!]?\s*\(", "db_write", "ar_create", ("ruby",)),
    (r"\.update[!]?\s*\(", "db_write", "ar_update", ("ruby",)),
    (r"\.destroy[!]?\s*\(", "db_write", "ar_destroy", ("ruby",)),
    (r"Net::HTTP", "network_call", "ruby_net_http", ("ruby",)),
    (r"HTTParty", "network_call", "httparty", ("ruby",)),
    (r"Faraday", "network_call", "faraday", ("ruby",)),
    (r"RestClient", "network_call", "rest_client", ("ruby",)),
    (r"File\.(open|read|write|delete)", "file_io", "ruby_file", ("ruby",)),
    (r"IO\.(read|write|foreach)", "file_io", "ruby_io", ("ruby",)),
    (r"Rails\.cache", "cache_op", "rails_cache", ("ruby",)),
    (r"Redis\.(new|current)", "cache_op", "ruby_redis", ("ruby",)),
    (r"raise\s+", "throws", "ruby_raise", ("ruby", "python",)),
    (r"rescue\s+", "catches", "ruby_rescue", ("ruby",)),
    (r"attr_(accessor|reader|writer)", "state_mutation", "ruby_attr", ("ruby",)),
    (r"Rails\.logger", "logging", "rails_logger", ("ruby",)),
    (r"go\s+func", "concurrency", "goroutine", ("go",)),
    (r"make\s*\(\s*chan\s", "concurrency", "go_channel_create", ("go",)),
    (r"<-\s*\w+", "concurrency", "go_channel_recv", ("go",)),
    (r"http\.(Get|Post|Head|NewRequest)", "network_call", "go_http", ("go",)),
    (r"sql\.Open", "db_read", "go_sql_open", ("go",)),
    (r"os\.(Open|Create|ReadFile|WriteFile)", "file_io", "go_os_file", ("go",)),
    (r"sync\.(Mutex|RWMutex|WaitGroup)", "acquires_lock", "go_sync", ("go",)),
    (r"std::thread", "concurrency", "cpp_thread", ("cpp",)),
    (r"std::mutex|std::lock_guard|std::unique_lock", "acquires_lock", "cpp_mutex", ("cpp",)),
    (r"std::(i|o)?fstream|std::ifstream|std::ofstream", "file_io", "cpp_fstream", ("cpp",)),
    (r"boost::asio", "network_call", "boost_asio", ("cpp",)),
    (r"asyncio\.(run|gather|create_task|ensure_future)", "concurrency", "python_asyncio", ("python",)),
    (r"aiohttp\.(ClientSession|request)", "network_call", "python_aiohttp", ("python",)),
    (r"sqlalchemy", "db_read", "sqlalchemy", ("python",)),
    (r"FastAPI|APIRouter", "network_call", "fastapi", ("python",)),
    (r"httpx\.(get|post|put|delete|AsyncClient)", "network_call", "python_httpx", ("python",)),
    (r"\b(launch|async|runBlocking|withContext|Dispatchers)\b", "concurrency", "kotlin_coroutine", ("kotlin",)),
    (r"\bRetrofit|OkHttpClient|HttpClient\b", "network_call", "kotlin_http", ("kotlin",)),
    (r"\b(Room|Exposed|Hibernate|JpaRepository)\b", "db_read", "kotlin_orm", ("kotlin",)),
    (r"\bFile\.(readText|writeText|readLines|readBytes)\b", "file_io", "kotlin_file", ("kotlin",)),
    (r"\b@Transactional\b", "transaction", "kotlin_transaction", ("kotlin",)),
    (r"\bsynchronized\s*\(", "acquires_lock", "kotlin_synchronized", ("kotlin",)),
    (r"\bMutex\b", "acquires_lock", "kotlin_mutex", ("kotlin",)),
    (r"\bTask\s*\{|async\s+let\b", "concurrency", "swift_structured_concurrency", ("swift",)),
    (r"\bURLSession\.(shared|data|download|upload)\b", "network_call", "swift_urlsession", ("swift",)),
    (r"\bAlamofire\b", "network_call", "swift_alamofire", ("swift",)),
    (r"\bCoreData|NSManagedObject|NSPersistentContainer\b", "db_read", "swift_coredata", ("swift",)),
    (r"\bFileManager\.(default|copyItem|moveItem|removeItem|createFile)\b", "file_io", "swift_filemanager", ("swift",)),
    (r"\bUserDefaults\b", "cache_op", "swift_userdefaults", ("swift",)),
    (r"\bos_unfair_lock|NSLock|DispatchSemaphore\b", "acquires_lock", "swift_lock", ("swift",)),
    (r"\b(PDO|mysqli|pg_query|pg_connect)\b", "db_read", "php_db", ("php",)),
    (r"\bEloquent|DB::table|DB::select|Model::(find|where|all)\b", "db_read", "php_eloquent", ("php",)),
    (r"\b(->save|->create|->update|->delete|->destroy)\s*\(", "db_write", "php_eloquent_write", ("php",)),
    (r"\bcurl_init|Guzzle|Http::get|Http::post\b", "network_call", "php_http", ("php",)),
    (r"\b(fopen|fwrite|fread|file_get_contents|file_put_contents)\b", "file_io", "php_file", ("php",)),
    (r"\bCache::(get|put|forget|remember)\b", "cache_op", "php_cache", ("php",)),
    (r"\bRedis::(get|set|del)\b", "cache_op", "php_redis", ("php",)),
    (r"\bAuth::(check|user|attempt|login|logout)\b", "auth_check", "php_auth", ("php",)),
    (r"\bDB::beginTransaction|DB::commit|DB::rollBack\b", "transaction", "php_transaction", ("php",)),
    (r"\bLog::(info|debug|warning|error|critical)\b", "logging", "php_log", ("php",)),
    (r"\bcurl\s", "network_call", "bash_curl", ("bash",)),
    (r"\bwget\s", "network_call", "bash_wget", ("bash",)),
    (r"\b(cat|head|tail|grep|awk|sed)\s", "file_io", "bash_file_read", ("bash",)),
    (r"\b(echo|printf)\s.*>>?\s", "file_io", "bash_file_write", ("bash",)),
    (r"\brm\s+-", "file_io", "bash_rm", ("bash",)),
    (r"\b(mysql|psql|sqlite3|mongosh)\s", "db_read", "bash_db_cli", ("bash",)),
    (r"\bsudo\s", "auth_check", "bash_sudo", ("bash",)),
    (r"\bflock\s", "acquires_lock", "bash_flock", ("bash",)),
    (r"JSON\.(parse|stringify)", "serialization", "json", ()),
    (r"json\.(dumps|loads|dump|load)", "serialization", "python_json", ()),
    (r"Jackson|ObjectMapper", "serialization", "jackson", ()),
    (r"Gson", "serialization", "gson", ()),
    (r"json\.Marshal|json\.Unmarshal", "serialization", "go_json", ()),
    (r"Newtonsoft|JsonConvert|System\.Text\.Json", "serialization", "csharp_json", ()),
)

# TypeScript and JavaScript.
SCRIPT_HINT_PATTERNS = (
    (r"\.authenticate\s*\(", "auth_check", "authenticate", ()),
    (r"\.authorize\s*\(", "auth_check", "authorize", ()),
    (r"verify(Token|JWT|Session)", "auth_check", "token_verify", ()),
    (r"\.isAuthenticated", "auth_check", "auth_check", ()),
    (r"\.validate\s*\(", "validation", "validate", ()),
    (r"Joi\.|Yup\.|Zod\.", "validation", "schema_validation", ()),
    (r"throw\s+new\s+\w+", "throws", "throws", ()),
    (r"catch\s*\(", "catches", "catches", ()),
    (r"this\.\w+\s*=", "state_mutation", "this_assignment", ()),
    (r"\.setState\s*\(", "state_mutation", "set_state", ()),
    (r"\.transaction\s*\(", "transaction", "db_transaction", ()),
    (r"BEGIN|COMMIT|ROLLBACK", "transaction", "sql_transaction", ()),
    (r"\.(lock|acquire|tryLock)\s*\(", "acquires_lock", "lock_acquire", ()),
    (r"[Mm]utex", "acquires_lock", "mutex", ()),
    (r"[Ss]emaphore", "acquires_lock", "semaphore", ()),
    (r"synchronized", "acquires_lock", "synchronized", ()),
    (r"JSON\.stringify", "serialization", "json_stringify", ()),
    (r"\.(serialize|marshal)\s*\(", "serialization", "serialize", ()),
    (r"\.toJSON\s*\(", "serialization", "to_json", ()),
    (r"protobuf", "serialization", "protobuf", ()),
    (r"\.encode\s*\(", "serialization", "encode", ()),
    (r"console\.(log|warn|error|info)", "logging", "console", ()),
    (r"log\.(debug|info|warn|error|fatal)", "logging", "structured_log", ()),
)
