"""Calls to services, told by the library in the name they resolve to, and the routes
they go to or register."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .derive import route_key

# Parts of resolved names that tell a library, by the kind of edge its calls make. Fixed
# values; a part that contains another one of its kind is left out, as that one matches.

ROUTERS = (
    "gin-gonic/gin", "gin.", "go-chi/chi", "chi.", "gorilla/mux", "labstack/echo", "echo.", "gofiber/fiber", "fiber.", "http.ServeMux", "httprouter",
    "express", "fastify", "koa-router", "hono", "hapi",
    "flask", "FastAPI", "starlette",
    "Laravel", "Illuminate.Routing", "Symfony.Routing",
    "ktor.server", "ktor.routing",
    "actix-web", "actix_web", "axum", "rocket",
    "Spring", "jakarta.ws.rs",
    "Microsoft.AspNetCore", "MapGet", "MapPost",
    "ActionDispatch", "Sinatra", "Phoenix.Router", "akka.http.scaladsl.server", "play.api.routing",
)

HTTP_CLIENTS = (
    "requests", "httpx", "aiohttp", "urllib", "httplib2", "treq", "uplink",
    "axios", "superagent", "needle", "node-fetch", "undici", "ofetch", "wretch", "sindresorhus/ky", "phin",
    "net/http", "resty", "sling", "heimdall", "gentleman", "retryablehttp",
    "HttpClient", "OkHttp", "okhttp3", "RestTemplate", "WebClient", "Unirest", "apache.http", "Retrofit", "Feign", "ktor.client", "kittinunf.fuel",
    "reqwest", "hyper", "surf", "ureq", "isahc", "attohttpc",
    "RestSharp", "Flurl", "Refit",
    "HTTParty", "Faraday", "RestClient", "Typhoeus", "Excon", "Net::HTTP",
    "Guzzle", "guzzle", "curl",
    "cpr", "cpp-httplib", "Poco.Net", "Beast",
    "Alamofire", "Moya", "URLSession",
    "Dio", "dio", "package:http", "Chopper",
    "HTTPoison", "Tesla", "Finch", "Mint.HTTP",
    "sttp", "akka.http", "http4s", "scalaj",
    "wreq", "http-client", "http-conduit", "servant-client", "Network.HTTP",
    "socket.http",
)

#: By broker.
BROKERS = {
    "cloud_tasks": ("cloudtasks", "cloud_tasks", "cloud.tasks", "CloudTasks"),
    "pubsub": ("pubsub", "PubSub"),
    "sqs": ("aws-sdk-go/service/sqs", "aws_sdk_sqs", "Amazon.SQS", "@aws-sdk/client-sqs", "boto3.client.sqs"),
    "sns": ("aws-sdk-go/service/sns", "aws_sdk_sns", "Amazon.SNS", "@aws-sdk/client-sns"),
    "eventbridge": ("eventbridge", "EventBridge"),
    "lambda": ("aws-sdk-go/service/lambda", "aws_sdk_lambda", "@aws-sdk/client-lambda"),
    "stepfunctions": ("stepfunctions",),
    "servicebus": ("ServiceBus", "Azure.Messaging"),
    "kafka": ("kafka", "Kafka", "sarama", "confluent"),
    "rabbitmq": ("amqp", "AMQP", "RabbitMQ", "lapin", "MassTransit"),
    "nats": ("nats", "NATS"),
    "redis": ("ioredis",),
    "celery": ("celery", "Celery"),
    "dramatiq": ("dramatiq",),
    "huey": ("huey",),
    "rq": ("python-rq", "rq.Queue"),
    "bullmq": ("bullmq", "BullMQ"),
    "bull": ("bull.Queue",),
    "sidekiq": ("Sidekiq", "sidekiq"),
    "resque": ("Resque",),
    "goodjob": ("GoodJob",),
    "delayed_job": ("DelayedJob",),
    "hangfire": ("Hangfire",),
    "nservicebus": ("NServiceBus",),
    "asynq": ("asynq",),
    "machinery": ("RichardKnop/machinery",),
    "temporal": ("temporalio", "temporal.client", "temporal.worker"),
    "inngest": ("inngest",),
    "oban": ("Oban",),
    "broadway": ("Broadway",),
    "genstage": ("GenStage",),
    "alpakka": ("Alpakka",),
    "mqtt": ("mqtt", "MQTTClient", "mosquitto"),
    "dapr": ("dapr.clients.grpc", "DaprClient"),
}

CONFIGURATION = (
    "getenv", "Getenv", "getEnv", "LookupEnv", "lookupEnv", "get_env", "fetch_env", "GetEnvironmentVariable", "getProperty",
    "viper", "envconfig",
    "decouple", "dynaconf", "dotenv",
    "nconf", "convict", "envalid",
    "figment", "config-rs",
    "ConfigFactory", "ConfigurationProperties",
)

GRPC = (
    "google.golang.org/grpc", "grpc.Dial", "grpc.NewClient",
    "grpc.insecure_channel", "grpc.secure_channel", "grpcio", "grpc.aio",
    "io.grpc", "ManagedChannel", "newBlockingStub", "newFutureStub",
    "Grpc.Net.Client", "GrpcChannel", "Grpc.Core",
    "@grpc/grpc-js", "grpc-web", "tonic", "package:grpc",
)

GRAPHQL = ("graphql-request", "@apollo/client", "apollo-client", "urql", "graphql-tag", "gql", "sgqlc", "graphene", "graphql-java", "DgsQueryExecutor", "graphql-go", "graphql-ruby", "async-graphql", "juniper")

TRPC = ("@trpc/server", "@trpc/client", "@trpc/react-query", "createTRPCRouter", "createTRPCProxyClient")

#: In the order of trial: routers also have get and post, so they come first.
KINDS = {
    "ROUTE": ROUTERS,
    "HTTP_CALLS": HTTP_CLIENTS,
    "ASYNC_CALLS": tuple(p for parts in BROKERS.values() for p in parts),
    "CONFIGURES": CONFIGURATION,
    "GRPC_CALLS": GRPC,
    "GRAPHQL_CALLS": GRAPHQL,
    "TRPC_CALLS": TRPC,
}


def _has(name: Column, parts: Iterable[str]) -> Column:
    return name.rlike("|".join(re.escape(p) for p in parts))


def service_kind(name: Column) -> Column:
    """ROUTE, or the edge type of calls to what a resolved name's library is; else CALLS."""
    out = F.when(name.isNull(), "CALLS")
    for kind, parts in KINDS.items():
        out = out.when(_has(name, parts), kind)
    return out.otherwise("CALLS")


def broker(name: Column) -> Column:
    """The broker of a library for messages, or null."""
    out = F.when(name.isNull(), F.lit(None).cast("string"))
    for of, parts in BROKERS.items():
        out = out.when(_has(name, parts), of)
    return out


def http_method(callee: Column) -> Column:
    """The method that a client's call makes by its last part, or null."""
    verb = F.regexp_extract(callee, r"\.(get|Get|GET|post|Post|POST|put|Put|PUT|delete|Delete|DELETE|patch|Patch|PATCH|head|Head|HEAD|options|Options)$|(Get|Post|Put|Delete)Async$|(get|post)For(?:Object|Entity)$", 0)
    return F.nullif(F.upper(F.regexp_replace(verb, r"^\.|Async$|For(?:Object|Entity)$", "")), F.lit(""))


def route_method(callee: Column) -> Column:
    """The method for which a router's call registers a handler, ANY for a mount, or null."""
    verb = F.regexp_extract(callee, r"\.(?:Map)?(GET|Get|get|POST|Post|post|PUT|Put|put|DELETE|Delete|delete|PATCH|Patch|patch)$|::(get|post|put|delete|patch)$", 0)
    any_ = callee.rlike(r"\.(?:Handle|HandleFunc|handle|Route|route|include_router|mount|add_url_rule|register_blueprint|use|register|add_route|add_api_route|add_api_websocket_route)$")
    return F.when(verb != "", F.upper(F.regexp_replace(verb, r"^(?:\.|::)(?:Map)?", ""))).when(any_, "ANY")


def service_edges(calls: DataFrame) -> DataFrame:
    """call_id, type, src, dst, route, method, broker, path of resolved calls.

    calls: call_id, src, callee, target (the name it resolves to), arg (its first string, or
    null). A client's call with a URL or a path, and a message's with a topic of three
    characters or more, go to a route; so does a router's with a path, as CALLS. Without
    one they are CALLS of their target, like those of no known library."""
    c = calls.select("call_id", "src", "callee", "target", F.coalesce("arg", F.lit("")).alias("arg"), service_kind(F.col("target")).alias("kind"))
    path, url = F.col("arg").startswith("/"), F.col("arg").contains("://")
    to_route = ((F.col("kind") == "HTTP_CALLS") & (path | url)) | ((F.col("kind") == "ASYNC_CALLS") & (path | url | (F.length("arg") > 2))) | ((F.col("kind") == "ROUTE") & path)
    method = F.when(F.col("kind") == "HTTP_CALLS", http_method(F.col("callee"))).when(F.col("kind") == "ROUTE", F.coalesce(route_method(F.col("callee")), F.lit("ANY")))
    c = c.withColumns({"to_route": to_route, "method": F.when(to_route, method), "broker": F.when(to_route & (F.col("kind") == "ASYNC_CALLS"), broker(F.col("target")))})
    message = F.concat(F.lit("__route__"), F.coalesce("broker", F.lit("async")), F.lit("__"), "arg")
    route = F.when(F.col("to_route"), F.when(F.col("kind") == "ASYNC_CALLS", message).otherwise(route_key(F.col("method"), F.col("arg"))))
    kind = F.when(F.col("kind") == "ROUTE", "CALLS").when(F.col("kind").isin("HTTP_CALLS", "ASYNC_CALLS") & ~F.col("to_route"), "CALLS").otherwise(F.col("kind"))
    return c.select("call_id", kind.alias("type"), "src", F.coalesce(route, F.col("target")).alias("dst"), route.alias("route"), "method", "broker", F.when(F.col("to_route"), F.col("arg")).alias("path"))


def mounted_handles(mounts: DataFrame, functions: DataFrame) -> DataFrame:
    """handler, route: functions with a route of their own (handler, file_path) to the
    prefix routes (route, path, file_path) that a file in a folder above them mounts, where
    their file's path has the prefix."""
    folder = F.regexp_extract("file_path", "^(.*/)[^/]*$", 1)
    m = mounts.select("route", F.ltrim(F.col("path"), F.lit("/")).alias("part"), folder.alias("folder")).where("folder <> ''").distinct()
    parts = F.split("file_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    f = functions.where(F.col("file_path").contains("/")).select("handler", "file_path", F.explode(above).alias("folder"))
    return f.join(m, "folder").where(F.col("file_path").contains(F.col("part"))).select("handler", "route").distinct()


def service_name(url: Column) -> Column:
    """The first label of a URL's host without a generated ending."""
    return F.regexp_replace(F.regexp_extract(url, r"://([^./:?#]+)", 1), r"-[a-z0-9]{8,12}-[a-z]{2,3}$", "")


def infra_handles(infra: DataFrame, handled: DataFrame) -> DataFrame:
    """handler, route: deployed URLs (route, url) to the handlers (handler, route, path,
    file_path) of a route whose path is a run of whole parts of the URL's path, or the other
    way round, in a file below a folder of the service's name; a handler of / needs the
    folder alone, a prefix route (for any method) the path alone."""
    path = F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1)
    i = infra.where(F.col("url").contains("://")).select(F.col("route").alias("infra"), service_name(F.col("url")).alias("service"), F.concat(F.regexp_replace(path, "/$", ""), F.lit("/")).alias("whole"))
    h = handled.select("handler", "path", F.col("route").startswith("__route__ANY__").alias("prefix"), F.split("file_path", "/").alias("folders"), F.concat(F.regexp_replace("path", "/$", ""), F.lit("/")).alias("own"))
    parts = lambda c: F.filter(F.split(c, "/"), lambda p: p != "")
    segment = lambda p: F.concat(F.lit("/"), p)
    i = i.withColumn("key", F.explode(F.array_distinct(F.concat(F.array("service"), F.transform(parts(F.col("whole")), segment)))))
    h = h.withColumn("key", F.explode(F.array_distinct(F.concat(F.when(F.col("own") == "/", F.slice("folders", 1, F.size("folders") - 1)).otherwise(F.array().cast("array<string>")), F.transform(parts(F.col("own")), segment)))))
    met = i.join(h, "key")
    here = F.array_contains("folders", F.col("service"))
    same = F.when(F.col("own") == "/", here).otherwise((here | F.col("prefix")) & (F.col("whole").contains(F.col("own")) | F.col("own").contains(F.col("whole"))))
    return met.where(same).select("handler", F.col("infra").alias("route")).distinct()


def grpc_routes(nodes: DataFrame) -> DataFrame:
    """route, name, service, handler: functions of .proto files inside a service's lines."""
    proto = nodes.where(F.col("file_path").contains(".proto"))
    s = proto.where("label = 'Class'").select("file_path", F.col("name").alias("service"), F.col("start_line").alias("lo"), F.col("end_line").alias("hi"))
    f = proto.where("label = 'Function'").select("file_path", "name", F.col("id").alias("handler"), "start_line", "end_line")
    inside = f.join(s, "file_path").where("start_line >= lo and end_line <= hi")
    return inside.select(F.concat(F.lit("__grpc__"), "service", F.lit("/"), "name").alias("route"), "name", "service", "handler")


def _file_path(path: Column) -> Column:
    """A path below a folder of routes as the path they serve: groups in parentheses are
    left out, [x] is a parameter, [...x] the rest."""
    below = F.regexp_extract(path, r"/routes/(.*/)?[^/]*$", 1)
    parts = F.filter(F.split(below, "/"), lambda p: (p != "") & ~p.rlike(r"^\(.*\)$"))
    named = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, r"^\[\.\.\.([^\]=]*)(=[^\]]*)?\]$", r"*$1"), r"^\[([^\]=]*)(=[^\]]*)?\]$", r":$1"))
    return F.concat(F.lit("/"), F.array_join(named, "/"))


def file_routes(defs: DataFrame) -> DataFrame:
    """route, method, path, handler of server modules whose place makes the route. defs:
    qualified_name, name, label, file_path."""
    kind = F.regexp_extract("file_path", r"/routes/(?:.*/)?\+(server|page\.server|layout\.server)\.[tj]s$", 1)
    d = defs.where(F.col("label").isin("Function", "Variable")).withColumn("kind", kind).where("kind <> ''")
    loads = (F.col("name") == "load") & (F.col("label") == "Function")
    method = (
        F.when((F.col("kind") == "server") & F.col("name").isin("GET", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "HEAD"), F.col("name"))
        .when((F.col("kind") == "server") & (F.col("name") == "fallback"), "ANY")
        .when((F.col("kind") != "server") & loads, "LOAD")
        .when((F.col("kind") == "page.server") & (F.col("name") == "actions"), "ACTIONS")
    )
    found = d.select(method.alias("method"), _file_path(F.col("file_path")).alias("path"), F.col("qualified_name").alias("handler")).where("method is not null")
    return found.select(F.concat(F.lit("__route__"), "method", F.lit("__"), "path").alias("route"), "method", "path", "handler")
