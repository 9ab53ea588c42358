"""Plain restatements of two rules, for brute-force checks on simple addresses."""

CATEGORY = {"hr": "HR Email", "talent": "Recruitment Email", "jobs": "Careers Email",
            "owner": "Manager Email", "info": "Info Email", "desk": "General Email"}


def category_of(email):
    return CATEGORY[email.split("@")[0]]


def root_of(email):
    return ".".join(email.split("@")[1].split(".")[-2:])
