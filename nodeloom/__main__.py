from nodeloom.cli import main

main()
