"""Patterns, rule expressions, word lists and report texts.

Everything in this module is a constant that results depend on.  It holds no
logic; the operators turn these values into Spark columns.
"""

from __future__ import annotations

# Expressions that find links in page text, matched without
# regard to case.  (name, expression)
PATH_PATTERNS = [
    ("quoted_absolute", r"""["'](/[^"'\s]+)["']"""),
    ("quoted_dotted", r"""["'](\.{1,2}/[^"'\s]+)["']"""),
    ("quoted_escaped", r"""["'](\\\\*/[^"'\s]+)["']"""),
    ("backquoted_absolute", r"""`(/([^`\s]+))`"""),
    ("backquoted_dotted", r"""`(\.{1,2}/[^`\s]+)`"""),
    ("link_attribute", r"""\b(?:href|src|action)\s*=\s*["']?([^"'\s>]+)"""),
    ("assets_file", r"""(assets/[a-zA-Z0-9_\-./]+\.(js|css|png|jpg|jpeg|svg|gif|woff2?|ttf|eot|mp4|mp3|json|map))"""),
    ("quoted_url", r"""['"`]((?:https?://|//)[^\s'"`]+)['"`]"""),
    ("any_quote_absolute", r"""['"`](/[^\s'"`]+)['"`]"""),
    ("any_quote_dotted", r"""['"`](\.{1,2}/[^\s'"`]+)['"`]"""),
    ("css_url", r"""url\(['"]?([^\s'")]+)['"]?\)"""),
    ("verb_call", r"""\.(?:get|post|put|delete|patch|options|head|connect)\(['"`]([^\s'"`]+)['"`]"""),
    ("window_location", r"""window\.location\s*=\s*['"`]([^\s'"`]+)['"`]"""),
    ("window_open", r"""window\.open\(['"`]([^\s'"`]+)['"`]"""),
    ("fetch_call", r"""fetch\(['"`]([^\s'"`]+)['"`]"""),
    ("axios_call", r"""axios\.(?:get|post|put|delete|patch|options|head|connect)\(['"`]([^\s'"`]+)['"`]"""),
    ("src_assignment", r"""\.src\s*=\s*['"`]([^\s'"`]+)['"`]"""),
    ("href_assignment", r"""\.href\s*=\s*['"`]([^\s'"`]+)['"`]"""),
    ("action_assignment", r"""\.action\s*=\s*['"`]([^\s'"`]+)['"`]"""),
    ("json_url", r"""['"`]url['"`]\s*:\s*['"`]([^\s'"`]+)['"`]"""),
    ("json_src_href", r"""['"`](?:src|href)['"`]\s*:\s*['"`]([^\s'"`]+)['"`]"""),
    ("template_url", r"""`(https?://[^`]+)`"""),
    ("template_path", r"""`(?:/{1,2}|\.{1,2}/)[^`]+`"""),
    ("router_push", r"""router\.(?:push|replace)\(['"`]([^\s'"`]+)['"`]"""),
    ("route_element", r"""<Route\s+path=['"`]([^\s'"`]+)['"`]"""),
    ("api_version", r"""['"`]/api/v\d+/[^\s'"`]+['"`]"""),
    ("server_page", r"""['"`]/\w+/\w+\.(?:php|aspx|jsp)[\?]?[^\s'"`]*['"`]"""),
    ("call_argument", r"""(?:\.get|\.post|\.ajax|fetch|axios\.get|axios\.post)\s*\(\s*(['"`]?)([a-zA-Z0-9_\/-]+)\1"""),
    ("data_interface", r"""['"`](/?DataInterface\\.do(?:\?[^\s'"`]*)?)['"`]"""),
    ("jquery_call", r"""\$\.(?:get|post|ajax)\s*\(\s*['"`]([^\s'"`]+)['"`]"""),
    ("template_any", r"""`(?:https?://[^`]+|/{1,2}[^`]+|\.{1,2}/[^`]+)`"""),
    ("router_add", r"""router\.(?:addRoute|addRoutes)\s*\(\s*['"`]([^\s'"`]+)['"`]"""),
    ("require_call", r"""require\s*\(\s*['"`](\.[^\s'"`]+)['"`]"""),
    ("import_call", r"""import\s*\(\s*['"`](\.[^\s'"`]+)['"`]"""),
]

# Tag and attribute pairs that hold links.
TAG_ATTRIBUTES = [
    ("script", "src"),
    ("link", "href"),
    ("img", "src"),
    ("a", "href"),
    ("form", "action"),
    ("iframe", "src"),
    ("video", "src"),
    ("audio", "src"),
    ("source", "src"),
    ("embed", "src"),
    ("object", "data"),
    ("track", "src"),
    ("applet", "code"),
    ("frame", "src"),
    ("portal", "src"),
    ("button", "formaction"),
    ("input", "src"),
    ("input", "formaction"),
    ("area", "href"),
    ("base", "href"),
    ("meta", "content"),
]

# Fixed value: bundler chunk entries, matched without regard to case.
WEBPACK_PATTERN = r'''"(chunk-[\w\d]+)":"([\w\d]+)"'''
WEBPACK_DIRECTORY = "static/js/"

# Link cleaning.
PSEUDO_SCHEMES = ["javascript:", "data:", "mailto:", "tel:"]
ALLOWED_PREFIX = r"^[a-zA-Z0-9:/?&=._~#%\\-]+"
FULL_URL = r"http[s]?://[^ ]+"

# URL validity.
VALID_SCHEMES = ["http", "https", "ftp", "sftp", "ws", "wss"]
MAX_URL_LENGTH = 2048

# File extensions that are not scanned when none are named.
DEFAULT_EXTENSIONS = [
    ".css", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".woff", ".woff2",
    ".ttf", ".eot", ".ico", ".mp4", ".mp3", ".avi", ".mov", ".pdf",
    ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".rar",
    ".gz", ".tar", ".7z", ".exe", ".dll", ".bin", ".swf", ".flv",
]

# The settings a scan starts from when a settings file leaves them out.
SETTINGS_EXTENSIONS = [".css", ".mp4"]
SETTINGS_MAX_DEPTH = 5

# Keywords that mark a link as dangerous to call.
DANGER_KEYWORDS = [
    "del", "delete", "insert", "logout", "loginout", "remove", "drop", "shutdown",
    "stop", "poweroff", "restart", "rewrite", "terminate", "deactivate", "halt", "disable",
]

# Sensitive-data rules in report order.  (key, report label, expression)
RULES = [
    ("cn_id_card", "身份证号", r"""\b[1-9]\d{5}(?:18|19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]\b"""),
    ("cn_mobile", "手机号", r"""\b1(?:3\d|4[5-9]|5[0-35-9]|6[5-7]|7[0-8]|8\d|9[189])\d{8}\b"""),
    ("cn_credit_code", "统一社会信用代码", r"""\b[0-9A-Z]{18}\b"""),
    ("cn_company_reg", "企业注册号", r"""\b\d{13,15}\b"""),
    ("private_ip", "内网IP", r"""\b(127\.0\.0\.1|10\.\d{1,3}\.\d{1,3}\.\d{1,3}|172\.(1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3})\b"""),
    ("ipv4", "IP地址", r"""\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"""),
    ("mac", "MAC地址", r"""\b([a-fA-F0-9]{2}[:-]){5}[a-fA-F0-9]{2}\b"""),
    ("email", "邮箱", r"""\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.(?!js|css|jpg|jpeg|png|ico|svg|gif|woff|ttf|eot|mp4|mp3|json|map|zip|rar|exe|dll|bin|swf|flv)[a-zA-Z]{2,10}\b"""),
    ("basic_bearer", "Basic认证", r"""\b(?:basic|bearer)\s+[a-zA-Z0-9=:_\+/-]{5,100}\b"""),
    ("authorization", "Authorization", r"""(?i)(basic [a-z0-9=:_\+/-]{5,100}|bearer [a-z0-9_.=:_\+/-]{5,100})"""),
    ("aliyun_key", "阿里云密钥", r"""\bLTAI[a-zA-Z0-9]{12,20}\b"""),
    ("tencent_key", "腾讯云密钥", r"""\bAKID[a-zA-Z0-9]{16,28}\b"""),
    ("baidu_key", "百度云密钥", r"""\bAK[a-zA-Z0-9]{32}\b"""),
    ("aws_access", "AWS访问密钥", r"""\bA[SK]IA[0-9A-Z]{16}\b"""),
    ("aws_key_id", "AWS密钥ID", r"""(A3T[A-Z0-9]|AKIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ASIA)[A-Z0-9]{16}"""),
    ("google_api", "Google API密钥", r"""\bAIza[0-9A-Za-z\-_]{35}\b"""),
    ("firebase", "Firebase密钥", r"""\bAAAA[A-Za-z0-9_-]{7}:[A-Za-z0-9_-]{140}\b"""),
    ("recaptcha", "Google验证码", r"""\b6L[0-9A-Za-z\-_]{38}\b"""),
    ("google_oauth", "Google OAuth", r"""\bya29\.[0-9A-Za-z\-_]+\b"""),
    ("twilio_key", "Twilio API密钥", r"""\bSK[0-9a-fA-F]{32}\b"""),
    ("twilio_account", "Twilio账户SID", r"""\bAC[a-zA-Z0-9_\-]{32}\b"""),
    ("twilio_app", "Twilio应用SID", r"""\bAP[a-zA-Z0-9_\-]{32}\b"""),
    ("stripe_live", "Stripe标准API", r"""\bsk_live_[0-9a-zA-Z]{24}\b"""),
    ("stripe_restricted", "Stripe限制API", r"""\brk_live_[0-9a-zA-Z]{24}\b"""),
    ("github_url_token", "GitHub访问令牌", r"""[a-zA-Z0-9_-]*:[a-zA-Z0-9_\-]+@github\.com"""),
    ("slack_token", "Slack令牌", r"""\bxox[baprs]-[0-9a-zA-Z]{10,48}\b"""),
    ("slack_webhook", "Slack Webhook", r"""https://hooks\.slack\.com/services/T[a-zA-Z0-9_]{8}/B[a-zA-Z0-9_]{8}/[a-zA-Z0-9_]{24}"""),
    ("mailgun", "Mailgun API密钥", r"""\bkey-[0-9a-zA-Z]{32}\b"""),
    ("square_access", "Square访问令牌", r"""\bsqOatp-[0-9A-Za-z\-_]{22}\b"""),
    ("square_oauth", "Square OAuth密钥", r"""\bsq0csp-[0-9A-Za-z\-_]{43}\b"""),
    ("braintree", "PayPal Braintree令牌", r"""\baccess_token\$production\$[0-9a-z]{16}\$[0-9a-f]{32}\b"""),
    ("facebook_token", "Facebook访问令牌", r"""\bEAACEdEose0cBA[0-9A-Za-z]+\b"""),
    ("facebook_client", "Facebook客户端ID", r"""(?i)(facebook|fb)(.{0,20})?['"][0-9]{13,17}['"]"""),
    ("facebook_secret", "Facebook密钥", r"""(?i)(facebook|fb)(.{0,20})?['"][0-9a-f]{32}['"]"""),
    ("twitter_oauth", "Twitter OAuth", r"""[t|T][w|W][i|I][t|T][t|T][e|E][r|R].{0,30}['"\s][0-9a-zA-Z]{35,44}['"\s]"""),
    ("twitter_secret", "Twitter密钥", r"""(?i)twitter(.{0,20})?['"][0-9a-z]{35,44}['"]"""),
    ("linkedin_secret", "LinkedIn密钥", r"""(?i)linkedin(.{0,20})?['"][0-9a-z]{16}['"]"""),
    ("github_secret", "Github密钥", r"""(?i)github(.{0,20})?['"][0-9a-zA-Z]{35,40}['"]"""),
    ("aliyun_oss", "阿里云OSS", r"""[\\w.]\.oss\.aliyuncs\.com"""),
    ("aws_s3", "AWS S3", r"""s3\.amazonaws\.com[/]+|[a-zA-Z0-9_-]*\.s3\.amazonaws\.com"""),
    ("aws_s3_url", "AWS S3 URL", r"""[a-zA-Z0-9-\.\_]+\.s3\.amazonaws\.com|s3://[a-zA-Z0-9-\.\_]+|s3-[a-zA-Z0-9-\.\_\/]+|s3\.amazonaws\.com/[a-zA-Z0-9-\.\_]+|s3\.console\.aws\.amazon\.com/s3/buckets/[a-zA-Z0-9-\.\_]+"""),
    ("cloudinary", "Cloudinary认证", r"""cloudinary://[0-9]{15}:[0-9A-Za-z]+@[a-z]+"""),
    ("db_url", "数据库连接", r"""(?i)(mysql|postgresql|mongodb|redis|oracle|sqlserver)://[a-zA-Z0-9_]+:[^@]+@[a-zA-Z0-9.-]+:[0-9]+/[a-zA-Z0-9_]+"""),
    ("jdbc", "JDBC连接", r"""jdbc:[a-z:]+://[a-zA-Z0-9_\-.:;=/@?,&]+"""),
    ("jwt", "JWT令牌", r"""\bey[A-Za-z0-9-_=]+\.[A-Za-z0-9-_=]+\.?[A-Za-z0-9-_.+/=]*\b"""),
    ("rsa_private", "RSA私钥", r"""-----BEGIN RSA PRIVATE KEY-----"""),
    ("any_private", "SSH私钥", r"""-----BEGIN [^\s]+ PRIVATE KEY-----"""),
    ("pgp_private", "PGP私钥", r"""-----BEGIN PGP PRIVATE KEY BLOCK-----"""),
    ("private_block", "SSH私钥块", r"""([-]+BEGIN [^\s]+ PRIVATE KEY[-]+[\s]*[^-]*[-]+END [^\s]+ PRIVATE KEY[-]+)"""),
    ("api_key_field", "API密钥", r"""(?i)(api[_-]?key|access[_-]?key|secret[_-]?key)\s*[:=]\s*['"][a-zA-Z0-9_\-]{10,}['"]"""),
    ("password_field", "密码", r"""(?i)(password|passwd|pwd|pass|passcode|userpass)\s*[:=]\s*['"][^'"]{6,}['"]"""),
    ("secret_field", "密钥字段", r"""(?i)(key|secret|token|config|auth|access|admin|ticket)\s*[:=]\s*['"][^'"]{6,}['"]"""),
    ("access_key_word", "OSS云存储桶", r"""([A|a]ccess[K|k]ey[I|i]d|[A|a]ccess[K|k]ey[S|s]ecret|[Aa]ccess-[Kk]ey)|[A|a]ccess[K|k]ey"""),
    ("secret_key_word", "Secret Key", r"""[Ss](ecret|ECRET)_?[Kk](ey|EY)"""),
    ("windows_path", "Windows路径", r"""(?:[a-zA-Z]:\\\\(?:[^<>:"/\\\\|?*\r\n]+\\\\)*[^<>:"/\\\\|?*\r\n]*)"""),
    ("named_secret", "Secrets", None),
]

# Variable names that the last rule looks for, in matching order,
# and the text that has to follow one of them.
SECRET_NAMES = [
    "access_key", "Access-Key", "access_token", "SecretKey", "SecretId", "admin_pass", "admin_user",
    "algolia_admin_key", "algolia_api_key", "alias_pass", "alicloud_access_key", "amazon_secret_access_key",
    "amazonaws", "ansible_vault_password", "aos_key", "api_key", "api_key_secret", "api_key_sid", "api_secret",
    "api.googlemaps", "AIza", "apidocs", "apikey", "apiSecret", "app_debug", "app_id", "app_key", "app_log_level",
    "app_secret", "appkey", "appkeysecret", "application_key", "appsecret", "appspot", "auth_token",
    "authorizationToken", "authsecret", "aws_access", "aws_access_key_id", "aws_bucket", "aws_key", "aws_secret",
    "aws_secret_key", "aws_token", "AWSSecretKey", "b2_app_key", "bashrc", "password", "bintray_apikey",
    "bintray_gpg_password", "bintray_key", "bintraykey", "bluemix_api_key", "bluemix_pass",
    "browserstack_access_key", "bucket_password", "bucketeer_aws_access_key_id",
    "bucketeer_aws_secret_access_key", "built_branch_deploy_key", "bx_password", "cache_driver",
    "cache_s3_secret_key", "cattle_access_key", "cattle_secret_key", "certificate_password",
    "ci_deploy_password", "client_secret", "client_zpk_secret_key", "clojars_password", "cloud_api_key",
    "cloud_watch_aws_access_key", "cloudant_password", "cloudflare_api_key", "cloudflare_auth_key",
    "cloudinary_api_secret", "cloudinary_name", "codecov_token", "config", "conn.login", "connectionstring",
    "consumer_key", "consumer_secret", "credentials", "cypress_record_key", "database_password",
    "database_schema_test", "datadog_api_key", "datadog_app_key", "db_password", "db_server", "db_username",
    "dbpasswd", "dbpassword", "dbuser", "deploy_password", "digitalocean_ssh_key_body",
    "digitalocean_ssh_key_ids", "docker_hub_password", "docker_key", "docker_pass", "docker_passwd",
    "docker_password", "dockerhub_password", "dockerhubpassword", "dot", "files", "dotfiles",
    "droplet_travis_password", "dynamoaccesskeyid", "dynamosecretaccesskey", "elastica_host", "elastica_port",
    "elasticsearch_password", "encryption_key", "encryption_password", "env.heroku_api_key",
    "env.sonatype_password", "eureka.awssecretkey",
]
SECRET_TAIL = r"""[a-z0-9_.\-,]{0,25}[a-z0-9A-Z_ .\-,]{0,25}(=|>|:=|\||:|<=|=>|:).{0,5}['"]([0-9a-zA-Z\-_=]{6,64})['"]"""

# Texts that appear in results and reports.
API_LINK = "接口"
NO_SAMPLE = "无样本"
UNKNOWN = "未知"
EXTERNAL = "外部"
DANGER = "危险"
DANGER_TITLE = "危险接口"
YES, NO = "是", "否"
TITLE_FAILED = "请求失败，状态码: "
NO_RESPONSE = "Error: No response and no error"
BLACKLISTED = "域名在黑名单中: "
NOT_WHITELISTED = "域名不在白名单中: "
OVER_BUDGET = "达到最大请求数限制"
SUMMARY_SEPARATOR = "，"
REDIRECT_SEPARATOR = " → "

# Error classes in the order they are tested, with the prefix each one gets.
ERROR_PREFIXES = [
    (["ConnectionError", "ProxyError", "SSLError", "ConnectTimeout"], "ConnectionError: "),
    (["Timeout", "ReadTimeout"], "TimeoutError: "),
    (["TooManyRedirects"], "TooManyRedirects: "),
    (
        [
            "RequestException", "HTTPError", "URLRequired", "MissingSchema", "InvalidSchema", "InvalidURL",
            "InvalidHeader", "InvalidProxyURL", "InvalidJSONError", "JSONDecodeError", "ChunkedEncodingError",
            "ContentDecodingError", "StreamConsumedError", "RetryError", "UnrewindableBodyError",
        ],
        "RequestError: ",
    ),
]

# Report columns.
REPORT_COLUMNS = [
    "url", "status", "title", "length", "link_type", "redirects", "depth",
    "sensitive_types", "sensitive_counts", "sensitive_details", "is_duplicate",
]
REPORT_HEADER = [
    "URL", "状态", "标题", "长度", "链接类型", "重定向", "深度",
    "敏感信息类型", "敏感信息数量", "敏感信息详细清单", "是否重复",
]

# Fixed value: body encodings tried for titles, in order.
TITLE_ENCODINGS = ["utf-8", "gbk", "gb2312", "utf-16"]

# Public suffixes as rules, in the notation of the public list (``*`` a label, ``!`` an exception) plus
# ``?`` for a character.  ``*`` alone is the list's own default: the last label of an unlisted name is its suffix.
# A generic label below a country code is taken as a suffix everywhere, which only narrows a scope where the list
# lacks it; callers pass the full list to be exact, and suffixes of hosting services if they count as separate owners.
PUBLIC_SUFFIXES = [
    "*", "com", "net", "org", "edu", "gov", "mil", "int", "info", "biz", "??",
    *(f"{label}.??" for label in ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "mil", "ne", "net", "nom", "or", "org", "sch")),
    "ltd.uk", "me.uk", "nhs.uk", "plc.uk", "police.uk", "ad.jp", "ed.jp", "gr.jp", "lg.jp", "id.au", "asn.au", "re.kr", "pe.kr",
    *(f"*.{name}" for name in ("bd", "ck", "er", "fk", "jm", "kh", "mm", "np", "pg")), "!www.ck",
    *(rule for city in ("kawasaki", "kitakyushu", "kobe", "nagoya", "sapporo", "sendai", "yokohama") for rule in (f"*.{city}.jp", f"!city.{city}.jp")),
]
