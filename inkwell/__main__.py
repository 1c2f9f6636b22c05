import sys

from .plans.pipeline import main

if __name__ == "__main__":
    for kind, path in main(sys.argv[1:]).items():
        print(kind, path)
