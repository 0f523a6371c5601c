"""Fixed tables of the planning domain, as Python rows and as small DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Fields of a project, in the order of the questionnaire (fixed values).
FIELDS = ("project_name", "project_description", "project_type", "tech_stack", "team_qa_size", "team_dev_size", "timeline", "methodology", "known_risks", "existing_automation", "compliance_requirements")

# Questions and hints of the questionnaire.
QUESTIONS = (
    ("project_name", "What is the name of your project?", "e.g., MyApp, E-commerce Platform, Banking API"),
    ("project_description", "Briefly describe what the product does. What problem does it solve and who are the users?", "e.g., A mobile app for tracking personal finances, used by individual consumers"),
    ("project_type", "What type of product are we testing?", "e.g., web app, mobile app (iOS/Android), REST API, microservices, embedded system, desktop app"),
    ("tech_stack", "What is the main technology stack?", "e.g., React + Node.js, Java Spring Boot, Python Django, Flutter, .NET"),
    ("team_qa_size", "How many people are on the QA team?", "e.g., 1, 2, or 'no dedicated QA — developers test their own code'"),
    ("team_dev_size", "How many developers are on the team?", "e.g., 3 frontend + 2 backend, or 5 full-stack developers"),
    ("timeline", "What is the project timeline or release deadline?", "e.g., 3 months, release in June 2026, ongoing product with monthly sprints"),
    ("methodology", "Does the team follow Agile, Waterfall, or another methodology?", "e.g., Scrum with 2-week sprints, Kanban, Waterfall, SAFe"),
    ("known_risks", "Are there any known high-risk areas or critical features?", "e.g., payment processing, user authentication, data migration, third-party integrations, performance under high load"),
    ("existing_automation", "Does the project have any existing automated tests?", "e.g., no automation yet, unit tests only, Selenium E2E suite, Postman API tests"),
    ("compliance_requirements", "Are there any compliance or regulatory requirements?", "e.g., GDPR, PCI-DSS, HIPAA, ISO 27001, none"),
)

# Quick-start templates (key, label, and the fields in order).
TEMPLATES = (
    ("web_app", "🌐 Web Application", "SaaS Web Application", "B2C SaaS platform with user authentication, subscription billing, and a feature-rich dashboard served to end consumers via browser.", "Web Application", "React, Node.js/Express, PostgreSQL, AWS (EC2, S3, RDS)", "2", "6", "6 months", "Agile/Scrum with 2-week sprints", "Third-party payment and OAuth integrations, authentication/session security, GDPR data handling and right-to-erasure flows.", "Playwright E2E test suite, Jest unit and integration tests", "GDPR, OWASP Top 10"),
    ("mobile_app", "📱 Mobile Application", "Mobile Application", "Cross-platform iOS and Android consumer app backed by a REST API, with offline-first data sync and push notifications via Firebase.", "Mobile Application", "React Native (iOS + Android), REST API backend, Firebase (Auth + Firestore + FCM)", "1", "4", "4 months", "Agile/Kanban with continuous delivery", "Device and OS fragmentation, offline mode data consistency, App Store and Play Store review/approval delays.", "Detox E2E automated tests for critical user flows", "GDPR, Apple App Store guidelines, Google Play Store policies"),
    ("microservices", "⚙️ Microservices / API", "Microservices Platform", "Event-driven backend composed of Python FastAPI microservices communicating over RabbitMQ, deployed on Kubernetes with a PostgreSQL data tier.", "Microservices / API", "Python FastAPI, Docker, Kubernetes, PostgreSQL, RabbitMQ, AWS (EKS, RDS, SQS)", "3", "10", "9 months", "DevOps/CI-CD pipeline with Agile 2-week iterations", "Service interdependencies and cascading failures, distributed transaction consistency, API versioning and backward compatibility.", "pytest integration test suite, k6 load and stress testing, Postman/Newman API collections", "SOC 2 Type II, PCI-DSS"),
    ("automotive", "🚗 Embedded / Automotive", "Automotive ECU Firmware", "Safety-critical C/C++ ECU firmware developed under AUTOSAR classic, communicating over CAN/LIN bus and validated with Hardware-in-the-Loop rigs.", "Embedded / Automotive", "C/C++, AUTOSAR Classic, CAN bus, LIN bus, Hardware-in-the-Loop (HiL) test bench, CANoe", "4", "8", "18 months", "V-Model with A-SPICE process framework", "Safety-critical function failures, real-time timing constraint violations, ISO 26262 ASIL level verification and traceability gaps.", "CANoe scripted test automation for bus communication, Google Test unit test framework", "ISO 26262 (ASIL B/C), A-SPICE Level 2, MISRA C"),
)
NO_TEMPLATE = "— Start from scratch —"

# Share of QA effort, in per cent, by type and methodology.
BASELINE = (
    ("embedded", "v-model", 30, 40), ("embedded", "agile", 35, 45), ("embedded", "", 30, 40),
    ("web", "agile", 15, 20), ("web", "waterfall", 25, 30), ("web", "", 15, 20),
    ("mobile", "agile", 20, 25), ("mobile", "", 20, 25),
    ("api", "agile", 15, 20), ("microservice", "agile", 15, 20), ("api", "", 15, 20),
    ("desktop", "agile", 20, 25), ("desktop", "", 20, 25),
    ("data", "agile", 20, 30), ("ml", "agile", 20, 30), ("default", "", 20, 25),
)

# Activities in order, with their shares in per cent.
ACTIVITIES = (
    (1, "Test Planning & Strategy", 5, 10), (2, "Test Design & Specification", 15, 20), (3, "Test Environment Setup", 5, 10),
    (4, "Automation Framework Setup", 10, 20), (5, "Test Execution — Functional", 25, 35), (6, "Test Execution — Non-functional", 10, 15),
    (7, "Defect Management & Retesting", 10, 15), (8, "Regression Testing", 10, 15), (9, "Reporting & Documentation", 5, 8),
)
AUTOMATION_SETUP = 4

# Buffer days of a risk by level, and its greatest share of the expected effort.
RISK_DAYS = {"critical": 5, "high": 3, "medium": 1, "low": 0}
RISK_SHARE, DEFAULT_RISK_SHARE = 0.35, 0.15


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *q) for k, q in enumerate(QUESTIONS, 1)], "ord int, key string, question string, hint string")


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "template string, label string, " + ", ".join(f"{f} string" for f in FIELDS))


def template_options(spark: SparkSession) -> DataFrame:
    """The choices of a form: no template first, then the labels in order."""
    return spark.createDataFrame([(0, NO_TEMPLATE, None), *((k, t[1], t[0]) for k, t in enumerate(TEMPLATES, 1))], "ord int, label string, template string")


def baseline(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BASELINE, "ptype string, meth string, pct_min int, pct_max int")


def activities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ACTIVITIES, "ord int, activity string, lo int, hi int")
